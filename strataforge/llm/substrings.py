"""Substring deduplication with difference-cover anchors.

Words stand at positions 0, 1, ...; the cover {0, 1, 3} modulo 7 holds, for every shift between two
texts, a pair of aligned positions. So two equal stretches of 13 words share an aligned anchor: a
window of 7 words that starts at a cover position in both. Only anchors are hashed for all
documents. Those that two documents share extend to the 13-word windows around them, and of equal
windows only those in the document with the smallest id stay.

Defined cases: a null text has no words; a null id comes after every id; rows with one id don't
remove each other's words; texts of fewer than 13 words keep all; an empty table gives an empty
result; other columns are carried only where asked. Windows are compared by two independent hashes of
64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm.blocks import BLOCK, CHECKED, ENTRIES, ID, TEXT, Words, blocked, carried, distinct, entry_rows, fragments_for, ids_of, joined, not_first_checked, of_kind, reports, shared, told, word_slices
from strataforge.llm.store import P, materialize
from strataforge.llm.textcore import packed_rows, ragged, span_hashes, window_hashes, windows

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
#: Words of a text, how many of them go, and the others joined by one space.
RESULT = [f"{P}n_words", f"{P}n_removed", f"{P}kept"]


class _Anchors(NamedTuple):
    """Anchors of a block, slice by slice: their words, texts and hashes; the distinct hashes and each anchor's number."""

    at: list[np.ndarray]
    text: list[np.ndarray]
    keys: np.ndarray
    number: np.ndarray
    several: np.ndarray


def _anchors(parts: list[Words], size: int) -> _Anchors:
    """The windows of ``size`` words that start at cover positions."""
    on, at, text = np.isin(np.arange(PERIOD), COVER), [], []
    for s in parts:
        here, of = windows(s.first, size)
        kept = on[(here - s.first[of]) % PERIOD]
        at.append(here[kept])
        text.append(of[kept])
    hashes = joined([window_hashes(s.hashes, x, size) for s, x in zip(parts, at, strict=True)], np.uint64)
    keys, number, least, most = distinct(hashes, joined([s.row + x for s, x in zip(parts, text, strict=True)]))
    return _Anchors(at, text, keys, number, (least != most).astype(np.uint8))


def cover_anchors(blocks: DataFrame, window: int, fragments: int) -> DataFrame:
    """Entries of the blocks' anchors; five bytes of a hash are enough before the exact step."""

    def entries(docs: pa.Table) -> pa.Table:
        found = _anchors(word_slices(docs[TEXT]), window - PERIOD + 1)
        return entry_rows(docs[BLOCK][0].as_py(), found.keys, found.several, fragments, 5)

    return blocks.groupBy(BLOCK).applyInArrow(entries, ENTRIES)


def starts_in(part: Words, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Words at which a whole window of a text starts, in the ranges ``begin .. end - 1`` of the texts."""
    begin, end = np.maximum(begin, part.first[text]), np.minimum(end, part.first[text + 1] - window + 1)
    ok, wanted = begin < end, np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(wanted, begin[ok], 1)
    np.add.at(wanted, end[ok], -1)
    return np.flatnonzero(np.cumsum(wanted)[:-1] > 0)


def around_anchors(window: int, fragments: int) -> Callable:
    """Of a block's slices: starts of the windows that hold an anchor that two documents share."""

    def locate(parts: list[Words], docs: pa.Table, found: pa.Table) -> list[np.ndarray]:
        anchors = _anchors(parts, window - PERIOD + 1)
        marked, done, out = told(of_kind(found, 0), anchors.keys, fragments)[anchors.number] > 0, 0, []
        for part, at, text in zip(parts, anchors.at, anchors.text, strict=True):
            good = marked[done : done + len(at)]
            done += len(at)
            out.append(starts_in(part, text[good], at[good] - PERIOD + 1, at[good] + 1, window))
        return out

    return locate


class _Candidates(NamedTuple):
    parts: list[Words]
    at: list[np.ndarray]
    ids: np.ndarray
    keys: np.ndarray
    number: np.ndarray
    entries: np.ndarray


#: Seed of the second hash of a word.
_CHECK = 0x5851F42D4C957F2D


def checks_of(part: Words, at: np.ndarray, window: int) -> np.ndarray:
    """A second hash of the windows that start ``at`` words of a slice, made from second hashes of their words."""
    inside = np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    some = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    hashes = np.zeros(len(part.starts), np.uint64)
    hashes[some] = span_hashes(part.data, part.starts[some], part.ends[some], _CHECK)
    return window_hashes(hashes, at, window)


def _candidates(docs: pa.Table, found: pa.Table, window: int, locate: Callable) -> _Candidates:
    """The windows of a block that ``locate`` finds, with their documents' ids; the distinct ones with their least id."""
    parts, doc_ids = word_slices(docs[TEXT]), ids_of(docs[ID])
    at = locate(parts, docs, found) if len(found) else [s.first[:0] for s in parts]
    ids = joined([doc_ids[s.row + np.searchsorted(s.first, x, "right") - 1] for s, x in zip(parts, at, strict=True)])
    checks = joined([checks_of(s, x, window) for s, x in zip(parts, at, strict=True)], np.uint64)
    keys, number, least, _ = distinct(joined([window_hashes(s.hashes, x, window) for s, x in zip(parts, at, strict=True)], np.uint64), ids, checks)
    entries = np.zeros(len(keys), CHECKED)
    entries["id"], entries["check"][number] = least, checks
    return _Candidates(parts, at, ids, keys, number, entries)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space (a string column)."""
    texts = len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))[keep]
    size = (ends - starts)[keep] + 1
    flat = np.append(data, np.uint8(0x20))[ragged(starts[keep], size)]
    end = np.cumsum(size)
    flat[end - 1] = 0x20
    final = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    whole = np.ones(len(flat), bool)
    whole[end[final] - 1] = False
    per = np.bincount(text, weights=size, minlength=texts).astype(np.int64)
    return packed_rows(np.maximum(per - 1, 0), flat[whole]).cast(pa.string())


def remove_repeats(blocks: DataFrame, size: int, found: DataFrame, window: int, locate: Callable, carry: list[str]) -> DataFrame:
    """The rows of ``blocks`` with ``RESULT``: words go that a window covers whose words also start in a document with a smaller id.

    ``locate`` names the windows that come into question, from a block's rows of ``found``.
    """
    fragments = fragments_for(blocks.sparkSession, size, 0.25)

    def entries(docs: pa.Table, here: pa.Table) -> pa.Table:
        if not len(docs) or not len(here):
            return entry_rows(0, np.zeros(0, np.uint64), np.zeros(0, CHECKED), fragments)
        got = _candidates(docs, here, window, locate)
        return entry_rows(docs[BLOCK][0].as_py(), got.keys, got.entries, fragments)

    def remove(docs: pa.Table, here: pa.Table) -> pa.Table:
        got = _candidates(docs, here, window, locate)
        gone = (got.entries["id"][got.number] < got.ids) | (told(of_kind(here, 1), got.keys, fragments)[got.number] > 0)
        n_words, n_removed, kept, done = [], [], [], 0
        for part, at in zip(got.parts, got.at, strict=True):
            flagged = at[gone[done : done + len(at)]]
            done += len(at)
            cover = np.zeros(len(part.starts) + 1, np.int64)
            cover[flagged] += 1
            cover[flagged + window] -= 1
            keep = np.cumsum(cover)[:-1] == 0
            n_words.append(np.diff(part.first))
            n_removed.append(np.diff(np.concatenate(([0], np.cumsum(~keep)))[part.first]))
            kept.append(joined_words(part.data, part.starts, part.ends, part.first, keep))
        return docs.select([ID, TEXT, *carried(carry)]).append_column(RESULT[0], pa.array(joined(n_words))).append_column(RESULT[1], pa.array(joined(n_removed))).append_column(RESULT[2], pa.chunked_array(kept, pa.string()))

    pairs = blocks.groupBy(BLOCK).cogroup(found.groupBy(BLOCK)).applyInArrow(entries, ENTRIES)
    both = found.unionByName(reports(pairs, size // 2, not_first_checked, 8, CHECKED).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    kinds = {f.name: f for f in blocks.schema.fields}
    schema = T.StructType([kinds[c] for c in (ID, TEXT, *carried(carry))] + [T.StructField(n, t) for n, t in zip(RESULT, (T.LongType(), T.LongType(), T.StringType()), strict=True)])
    return blocks.groupBy(BLOCK).cogroup(both.groupBy(BLOCK)).applyInArrow(remove, schema).toDF(ID, TEXT, *carry, *RESULT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: _sf_id, _sf_text, ``carry`` and ``RESULT``."""
    if window <= PERIOD:
        raise ValueError(f"a window must be longer than the cover's period, {PERIOD}")
    blocks, size = blocked(docs, id_col, text_col, carry or [])
    fragments = fragments_for(docs.sparkSession, size, len(COVER) / PERIOD)
    found = materialize(reports(cover_anchors(blocks, window, fragments), size // 2, shared, 5, "u1").withColumn("kind", F.lit(0)), "anchors")
    return remove_repeats(blocks, size, found, window, around_anchors(window, fragments), carry or [])


def digests(out: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    return out.select(F.col(ID).alias("doc_id"), F.col(RESULT[0]).alias("n_words"), F.col(RESULT[1]).alias("n_removed"), F.sha2(RESULT[2], 256).alias("kept_sha256"))


def op10_substring(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that start in an earlier document."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(out)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
     f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS m FROM s) WHERE m < doc_id),
     r AS (SELECT DISTINCT doc_id, i + o AS i FROM f, unnest(range(0, 13)) AS t(o)),
     a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
     k AS (SELECT a.doc_id, a.i, a.word, r.i IS NOT NULL AS removed FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.i = r.i),
     g AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
