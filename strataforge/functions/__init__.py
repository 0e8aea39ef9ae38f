"""Column functions: identities, paths, typed JSON values."""

from collections.abc import Callable
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def finite(value: Column) -> Column:
    """Not null, not NaN and not infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < INFINITY), F.lit(False))


def finite_nonnegative(value: Column) -> Column:
    return finite(value) & (value >= 0)


def fullmatch(value: Column, pattern: str) -> Column:
    """The whole of ``value`` matches; a trailing newline doesn't slip through."""
    return F.coalesce(F.regexp_like(value, F.lit(rf"\A(?:{pattern})\z")), F.lit(False))


def content_sha256(value: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes or of bytes."""
    return F.sha2(value, 256)


def blob_id(value: Column) -> Column:
    """The identity of a stored blob: SHA-1 over a header with the length, a NUL and the bytes."""
    raw = F.encode(value, "utf-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "utf-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), raw))


def blob_id_of_bytes(raw: Column) -> Column:
    """``blob_id`` of a binary column."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "utf-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), raw))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decoded_base64(content: Column) -> Column:
    """The bytes of base64 text, or null where it isn't base64.

    Lenient decoding: ASCII characters beyond the alphabet are skipped (others make it no base64); padding ends the text where it completes a group of
    four (two or three letters and one or two signs in a row), and is skipped elsewhere; without such an end the letters
    must be whole groups.
    """

    def sign(state: Column, letters: Column) -> Column:
        held = F.concat(state.held, letters)
        row = F.when(letters == "", state.row).otherwise(0) + F.when(F.length(held) % 4 >= 2, 1).otherwise(0)
        ends = (F.length(held) % 4 >= 2) & (F.length(held) % 4 + row >= 4)
        return F.when(state.ended, state).otherwise(F.struct(held.alias("held"), row.alias("row"), ends.alias("ended")))

    def split(clean: Column) -> Column:
        """Letters of a text with signs among them."""
        parts = F.split(clean, "=", -1)
        last = F.element_at(parts, -1)
        start = F.struct(F.lit("").alias("held"), F.lit(0).alias("row"), F.lit(False).alias("ended"))
        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, sign, lambda s: F.when(s.ended, s.held).when(F.length(F.concat(s.held, last)) % 4 == 0, F.concat(s.held, last)))

    def letters(clean: Column) -> Column:
        body = F.rtrim(clean, F.lit("="))
        over = F.length(body) % 4
        whole = (over == 0) | ((over >= 2) & (over + F.length(clean) - F.length(body) >= 4))
        return F.when(body.contains("="), split(clean)).when(whole, body)

    ascii = ~F.regexp_like(content, F.lit(r"[^\x00-\x7f]"))
    text = _once(F.when(ascii, F.regexp_replace(content, r"[^A-Za-z0-9+/=]+", "")), letters)
    return _once(text, lambda t: F.unbase64(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "=")))


def encoded_base64(raw: Column) -> Column:
    """Base64 text of bytes, in one line."""
    return F.regexp_replace(F.base64(raw), r"[\r\n]", "")


def short_digest(value: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def safe_path(path: Column) -> Column:
    """A relative path without a parent segment or a backslash."""
    ok = (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.array_contains(F.split(path, "/"), "..")
    return F.coalesce(ok, F.lit(False))


def safe_repository(name: Column) -> Column:
    return fullmatch(name, r"[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+")


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path lies below one of the allowed prefixes."""
    return F.coalesce(F.exists(F.array(*map(F.lit, prefixes)), lambda prefix: path.startswith(prefix)), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form: keys sorted at every depth, no spaces, ASCII with escapes; null where invalid.

    A text is any JSON value. Integers keep all their digits, reals take their shortest form, and of repeated keys the
    last one counts. NaN and infinities (a real too large is one) have no canonical form.
    """

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), allow_nan=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def config_text(texts: pd.Series) -> pd.Series:
    """JSON objects as the text of a configuration file: sorted keys, spaces after signs, no escapes beyond ASCII's, a final newline; null for anything else."""

    def one(text: str | None) -> str | None:
        try:
            value = None if text is None else json.loads(text)
            return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False) + "\n" if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def canonical_json_digest(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical_json(text), 256)


def canonical_digest(entries: Column) -> Column:
    """SHA-256 of a map's canonical JSON."""
    return canonical_json_digest(F.to_json(entries))


def strict_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value: trailing matter, NaN and Infinity are refused.

    One wrap alone can be escaped by a text that closes it, so two different ones must agree.
    Objects that repeat a key count as invalid.
    """
    one = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    other = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(one & other, F.lit(False))


def json_kind(value: Column) -> Column:
    """The lexical kind of a variant: object, array, string, boolean, null, int or real."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").when(name == "BIGINT", "int").when(name.isNotNull(), "real")
    )


#: White space as Python's strip knows it: Unicode's and the separators 0x1C to 0x1F.
_SPACE = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """A text without white space, in any script, at either end."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def field(value: Column, name: str) -> Column:
    """A field of a variant object, or null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def blank(text: Column) -> Column:
    """Nothing but white space, in any script, or the separators 0x1C to 0x1F."""
    return F.regexp_like(text, F.lit(rf"(?U)\A{_SPACE}*\z"))
