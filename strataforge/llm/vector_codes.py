"""Vector code compression: a product quantizer whose codebooks are fitted by ball k-means.

Components become integers, vectors are cut into ``PARTS`` parts, and a part's code is the number of
the nearest entry of its position's codebook. Every vector takes part in every round; codebooks and sums
are all that passes through the driver (``ENTRIES`` rows a part), and codes are written by round.

A round starts from the codes of the round before. The parts of an entry in a batch are its ball. By the
triangle inequality entry i can only be as near to a part of ball j as j is where
|c_i - c_j| <= 2 |x - c_j|, so of the entries sorted by their distance from c_j only a first stretch counts:
the ball's radius bounds it for all of its parts (its neighbour entries), a part's own distance for that
part (its ring). Parts for which only j remains are the stable core and are not compared at all; the rest is
compared with the stretch of its ring, rounded up to a power of two (or, where that is a large share of the
entries, with all of them at once). Squared distances are whole numbers and exact, so the codes are those of
a comparison with every entry.

The vectors are shuffled once, into a table bucketed by row identity; each round's codes are bucketed
alike and meet them in place.

Defined cases: a vector that is null, empty, or holds a null or non-finite component is dropped, and so is
one whose length isn't that of the vector with the smallest id; with fewer vectors than ``ENTRIES`` each has
an entry; equal ids are taken in the order of their components, null ids after all others; a length that
``PARTS`` doesn't divide gives the first parts one component more; components are held within what 64-bit
sums of squares bear; a null label is a label of its own; repeated rows are rows of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.blocks import BUCKETS
from strataforge.llm.store import PART_BYTES, RID, TABLES, P, identified, is_scan, materialize, partitions, with_group, written

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by before it is floored.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Wider rings than one in so many entries are compared with all entries at once.
WIDE = 8
_ROWS = f"{RID[0]} long, {RID[1]} long, code binary, error long, part int, entry int, n long, sums array<long>"
_SLICE = 1 << 15


def cuts(length: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(length), PARTS)]).tolist()]


class Balls:
    """One position's entries, and for each entry all entries by their distance from it."""

    def __init__(self, entries: np.ndarray, exact_kind: type) -> None:
        self.entries = entries.astype(exact_kind)
        self.norms = (self.entries * self.entries).sum(axis=1)
        between = self._squares(self.entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.compared = 0

    def _squares(self, parts: np.ndarray) -> np.ndarray:
        """Squared distances of ``parts`` to every entry: whole numbers, exact in the chosen kind."""
        return (parts * parts).sum(axis=1)[:, None] - 2 * (parts @ self.entries.T) + self.norms

    def nearest(self, parts: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (ties: the first) and its squared distance, starting from the entries ``now``."""
        parts = parts.astype(self.entries.dtype)
        gap = parts - self.entries[now]
        code, error = now.copy(), (gap * gap).sum(axis=1)
        ring = self._rings(now, error)
        count = len(self.entries)
        width = np.where(ring * WIDE > count, count, 1 << np.ceil(np.log2(np.maximum(ring, 1))).astype(int))
        for w in np.unique(width[ring > 1]):
            some = np.flatnonzero((width == w) & (ring > 1))
            self.compared += len(some) * int(w)
            for at in np.split(some, range(_SLICE // 8, len(some), _SLICE // 8)):
                if w >= count:
                    squares = self._squares(parts[at])
                    code[at] = squares.argmin(axis=1)
                    error[at] = np.take_along_axis(squares, code[at][:, None], 1)[:, 0]
                else:
                    near = self.order[now[at], :w]
                    gap = parts[at][:, None, :] - self.entries[near]
                    squares = (gap * gap).sum(axis=2)
                    error[at] = squares.min(axis=1)
                    code[at] = np.where(squares == error[at][:, None], near, count).min(axis=1)
        return code, error.astype(np.int64)

    def _rings(self, now: np.ndarray, error: np.ndarray) -> np.ndarray:
        """How many entries, nearest to its own first, can be as near to each part as its own."""
        order = np.argsort(now, kind="stable")
        edges = np.searchsorted(now[order], np.arange(len(self.entries) + 1))
        ring = np.empty(len(now), np.int64)
        for j in np.flatnonzero(np.diff(edges)):
            ball = order[edges[j] : edges[j + 1]]
            radius = error[ball].max()
            neighbours = self.sorted[j][: np.searchsorted(self.sorted[j], 4 * radius, "right")]
            ring[ball] = np.searchsorted(neighbours, 4 * error[ball], "right")
        return ring


def _assign(books: list[np.ndarray], kind: type, sums: bool) -> Callable:
    """Rows (identity, whole components, code) to rows with the new code and error, and at a task's end its sums by entry."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b, kind) for b in books]
        at = cuts(sum(b.shape[1] for b in books))
        total = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
        last = None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            whole = batch.column(2).flatten().to_numpy().reshape(n, at[-1])
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
            error = np.zeros(n, np.int64)
            for k, ball in enumerate(balls):
                parts = whole[:, at[k] : at[k + 1]]
                codes[:, k], squares = ball.nearest(parts, codes[:, k])
                error += squares
                if sums:
                    order = np.argsort(codes[:, k], kind="stable")
                    entry, first = np.unique(codes[order, k], return_index=True)
                    total[k][0][entry] += np.diff(np.append(first, n))
                    total[k][1][entry] += np.add.reduceat(parts[order].astype(np.int64), first, axis=0)
            last = (batch.column(0)[n - 1].as_py(), batch.column(1)[n - 1].as_py())
            made = pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary())
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, pa.array(error), *none], _NAMES)
        if last and sums:
            # under the identity of one of its rows, so that the sums stay in the task's bucket
            found = [(*last, None, None, k, int(e), int(total[k][0][e]), total[k][1][e].tolist()) for k in range(PARTS) for e in np.flatnonzero(total[k][0])]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], _NAMES)

    return assign


_NAMES = [x.split(" ")[0] for x in _ROWS.split(", ")]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    name = f"{TABLES}{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, *RID).option("compression", "zstd").saveAsTable(written(name))
    return rows.sparkSession.table(name)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, scan: bool | None = None) -> tuple[DataFrame, int, int]:
    """A bucketed table of the usable rows (identity, vec_id, label, whole components), its buckets, and the vectors' length."""
    scan = is_scan(embeddings) if scan is None else scan
    rows = identified(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"), *(["_metadata"] if scan else [])), "vec_id", "vector", "label", scan=scan)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where(F.coalesce((F.size("vector") > 0) & F.forall("vector", finite), F.lit(False)))
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    length = first[0] if first else 0
    most = math.isqrt((1 << 59) // max(length, 1))
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most * 1.0)), F.lit(most * 1.0))).cast("int"))
    kept = good.where(F.size("vector") == length).select(*RID, "vec_id", "label", whole.alias("whole"))
    size = int(kept.agg(F.count("*")).first()[0]) * length * 4
    buckets = max(partitions(embeddings.sparkSession), min(size // PART_BYTES + 1, BUCKETS))
    return _bucketed(kept.repartition(buckets, *RID), buckets), buckets, length


def first_books(table: DataFrame, length: int) -> list[np.ndarray]:
    """The codebooks to start from: the parts of the ``ENTRIES`` smallest ids."""
    found = [r.whole for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(ENTRIES).collect()]
    whole, at = np.array(found, np.int64).reshape(len(found), length), cuts(length)
    return [whole[:, at[k] : at[k + 1]] for k in range(PARTS)]


def fit_codes(table: DataFrame, buckets: int, length: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes and errors of every row of ``table`` (identity, code, error), and the codebooks after ``rounds`` rounds."""
    books = first_books(table, length)
    if not len(books[0]):
        return table.select(*RID, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), books
    largest = table.agg(F.max(F.greatest(F.abs(F.array_max("whole")), F.abs(F.array_min("whole"))))).first()[0]
    kind = np.float64 if 4 * length * largest**2 < 1 << 52 else np.int64
    codes = None
    for k in range(rounds + 1):
        before = table.withColumn("code", F.lit(bytes(PARTS))) if codes is None else table.join(codes, RID)
        made = _bucketed(before.select(*RID, "whole", "code").mapInArrow(_assign(books, kind, k < rounds), _ROWS), buckets)
        codes = made.where("part is null").select(*RID, "code", "error")
        if k < rounds:
            sums = made.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(max(b.shape[1] for b in books))))
            books = [b.copy() for b in books]
            for part, entry, n, *total in sums.collect():  # PARTS x ENTRIES rows
                book = books[part]
                book[entry] = np.array(total[: book.shape[1]], np.int64) // n
    return codes, books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded(codes: DataFrame, books: list[np.ndarray], column: str = "code") -> DataFrame:
    """``codes`` with ``whole``, the entries that each code names (the codebooks are ``PARTS`` x ``ENTRIES`` literals)."""
    entry = lambda k: F.get(F.from_json(F.lit(str(books[k].tolist())), "array<array<int>>"), F.conv(F.hex(F.substring(column, k + 1, 1)), 16, 10).cast("int"))
    return codes.withColumn("whole", F.concat(*(entry(k) for k in range(PARTS))))


def vector_codes(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, scan: bool | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """One row per kept row of ``embeddings`` (identity, vec_id, label, code, error, label_error), and the codebooks."""
    table, buckets, length = whole_vectors(embeddings, id_col, vector_col, label_col, scan=scan)
    codes, books = fit_codes(table, buckets, length)
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = materialize(table.join(codes, RID).select(*RID, "vec_id", "label", group.alias(f"{P}label"), "code", "error"), "codes")
    groups = materialize(rows.groupBy(f"{P}label").agg(F.sum("error").alias("label_error"), F.count("*").alias(f"{P}size")), "labels")
    return with_group(rows, groups, f"{P}label", f"{P}size").drop(f"{P}label", f"{P}size"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all usable vectors under codebooks of four rounds."""
    found, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scan=True)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    assign = """a{k} AS MATERIALIZED (
    SELECT vec_id, part, x, unnest(x) AS v, generate_subscripts(x, 1) AS pos, entry, error FROM (
        SELECT p.vec_id, p.part, any_value(p.x) AS x,
               arg_min(b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + b.entry) AS entry,
               min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error
        FROM p JOIN b{k} b ON b.part = p.part GROUP BY p.vec_id, p.part)
)"""
    update = """b{n} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY pos) AS x FROM (
            SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS mean FROM a{k} GROUP BY part, entry, pos) GROUP BY part, entry
    ) m ON m.part = b.part AND m.entry = b.entry
)"""
    steps = [assign.format(k=0)]
    for k in range(ROUNDS):
        steps += [update.format(k=k, n=k + 1), assign.format(k=k + 1)]
    return f"""
WITH w AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT vec_id, k AS part, x[k * len(x) // {PARTS} + 1 : (k + 1) * len(x) // {PARTS}] AS x FROM w, (SELECT unnest(range({PARTS})) AS k)
), b0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
    WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT {ENTRIES})
), {", ".join(steps)}, c AS (
    SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
    FROM (SELECT DISTINCT vec_id, part, entry, error FROM a{ROUNDS}) GROUP BY vec_id
), s AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN w USING (vec_id), s
"""


OP13_SQL = _sql()
