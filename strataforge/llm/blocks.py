"""Texts in bucketed blocks, and fragments that report on the blocks' distinct hashes.

The substring and Jaccard operators look at every word several times, each time with decisions that
came from all documents. The texts are therefore written once, bucketed by block (a run of rows of
bounded bytes that one task wrote): meeting decisions later shuffles the decisions, never the texts.

A block sends each of its distinct hashes once, with what its documents say of it, to the fragment
that owns the hash's range. A fragment answers with a byte per hash, in the order they were sent. So
a hash that stands in a third of all documents is an entry per block, never a list of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm.pieces import cells
from strataforge.llm.store import PART_BYTES, TABLES, P, dealt, partitions, quoted, total_bytes, written
from strataforge.llm.textcore import LOWER, packed_rows, ragged, slices, span_hashes, text_buffer, words

BLOCK, SLOT, ID, TEXT = (f"{P}{x}" for x in ("block", "slot", "id", "text"))
#: Rows of a block at most (a slot fits 16 bits), its bytes (and one text more) least and most, and
#: blocks per partition that a small table aims at.
BLOCK_ROWS, BLOCK_BYTES, BLOCKS = 1 << 14, (1 << 20, 16 << 20), 4
#: Buckets at most, as Spark allows.
BUCKETS = 100_000
#: Entries that a fragment aims at.
FRAGMENT_ENTRIES = 2 << 20
ENTRIES = f"{P}fragment int, {BLOCK} long, hashes binary, extra binary"
REPORT = f"{BLOCK} long, {P}fragment int, told binary"
_LAST = np.iinfo(np.int64).max


def carried(carry: list[str]) -> list[str]:
    """Names under which a block table carries other columns, whatever they are called."""
    return [f"{P}c{k}" for k in range(len(carry))]


def _deal(limit: int) -> Callable:
    """Block and slot of each row, as rows of a task pass by."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            offsets, n, i = text_buffer(batch.column(1))[1], len(batch), 0
            blocks, numbers = np.empty(n, np.int64), np.empty(n, np.int32)
            while i < n:
                if rows >= BLOCK_ROWS or (rows and held >= limit):
                    block, rows, held = block + 1, 0, 0
                fit = int(np.searchsorted(offsets, offsets[i] + limit - held, "right")) - 1
                j = min(max(fit, i + 1), i + BLOCK_ROWS - rows, n)
                blocks[i:j], numbers[i:j] = block, np.arange(rows, rows + j - i)
                rows, held, i = rows + j - i, held + int(offsets[j] - offsets[i]), j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), pa.array(numbers)], [*batch.schema.names, BLOCK, SLOT])

    return deal


def blocked(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, int]:
    """A table of the rows of ``docs`` (id, text, ``carry`` as ``carried``), bucketed by block, and its texts' bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias(ID), F.col(text_col).cast("string").alias(TEXT), *(F.col(quoted(c)).alias(n) for c, n in zip(carry, carried(carry), strict=True)))
    size = total_bytes(rows, TEXT)
    low, high = BLOCK_BYTES
    placed = rows.mapInArrow(_deal(min(max(size // (BLOCKS * partitions(spark)), low), high)), T.StructType([*rows.schema.fields, T.StructField(BLOCK, T.LongType()), T.StructField(SLOT, T.IntegerType())]))
    name = f"{TABLES}{uuid.uuid4().hex}"
    placed.write.bucketBy(max(partitions(spark), min(size // PART_BYTES + 1, BUCKETS)), BLOCK).option("compression", "zstd").saveAsTable(written(name))
    return spark.table(name), size


class Words(NamedTuple):
    """A slice of a block: its first row, bytes, words by bytes, each text's first word, hashes of the words."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def word_slices(column: pa.ChunkedArray, lower: bool = False) -> list[Words]:
    out = []
    for i, _, data, offsets in slices(column.combine_chunks()) if len(column) else ():
        data = LOWER[data] if lower else data
        starts, ends, first = words(data, offsets)
        out.append(Words(i, data, starts, ends, first, span_hashes(data, starts, ends)))
    return out


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The ids as int64; a null comes after every id."""
    return np.asarray(column.fill_null(_LAST).to_numpy(), np.int64)


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def distinct(hashes: np.ndarray, values: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, each entry's number among them, and least and largest value of each.

    With ``checks``, a second hash of each entry, entries are equal where both are; a hash may then come several times.
    """
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    edge = np.append(True, np.diff(hashes[order]) != 0) if len(order) else np.zeros(0, bool)
    if checks is not None and len(order):
        edge[1:] |= np.diff(checks[order]) != 0
    start, inverse = np.flatnonzero(edge), np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(edge) - 1
    if not len(start):
        return hashes, inverse, values, values
    return hashes[order][start], inverse, np.minimum.reduceat(values[order], start), np.maximum.reduceat(values[order], start)


def fragments_for(spark, size: int, share: float) -> int:  # noqa: ANN001
    """Fragments for ``share`` of the words of texts of ``size`` bytes."""
    return max(partitions(spark), int(size / 6 * share / FRAGMENT_ENTRIES) + 1)


def _place(keys: np.ndarray, fragments: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def entry_rows(block: int, keys: np.ndarray, extra: np.ndarray, fragments: int, width: int = 8) -> pa.Table:
    """A block's distinct hashes (ascending) by fragment, with a value for each.

    ``width`` low bytes of a hash travel (its fragment is part of it too): all 8 where equal hashes
    decide, fewer where an exact step follows.
    """
    fragment = _place(keys, fragments)
    start = np.flatnonzero(np.append(True, np.diff(fragment) != 0)) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(keys)))
    low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel()
    return pa.table([pa.array(fragment[start], pa.int32()), pa.array(np.full(len(start), block), pa.int64()), packed_rows(count * width, low), packed_rows(count, extra)], names=[x.split(" ")[0] for x in ENTRIES.split(", ")])


def _report(width: int, kind: str | np.dtype, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """A fragment's function: group entries by hash, let ``decide`` tell a byte for each, 0 for nothing to tell."""

    def report(table: pa.Table) -> pa.Table:
        raw, at = cells(table["hashes"])
        n = len(raw) // width
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw.reshape(n, width)
        keys = wide.view("<u8")[:, 0]
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if n else np.zeros(0, np.int64)
        values, begin, count = np.zeros(n, np.uint8), at[:-1] // width, np.diff(at) // width
        if n:
            values[order] = decide(start, np.diff(np.append(start, n)), cells(table["extra"])[0].view(kind)[order])
        some = np.maximum.reduceat(values, begin) > 0 if n else np.zeros(len(table), bool)
        kept = table.select([BLOCK, f"{P}fragment"]).filter(pa.array(some))
        return kept.append_column("told", packed_rows(count[some], values[ragged(begin[some], count[some])]))

    return report


def shared(start: np.ndarray, size: np.ndarray, several: np.ndarray) -> np.ndarray:
    """1 for hashes that two blocks hold, or several documents of one."""
    return np.repeat((size > 1) | (np.maximum.reduceat(several, start) > 0), size)


def not_first(start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1 where another block holds the hash in a document with a smaller id than any of this one."""
    return np.repeat(np.minimum.reduceat(ids, start), size) < ids


#: An entry of 128 bits: a least id, and a second hash beside the one that is sent.
CHECKED = np.dtype([("id", "<i8"), ("check", "<u8")])


def not_first_checked(start: np.ndarray, size: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``not_first`` for ``CHECKED`` entries: only those count as the same hash whose second hashes agree too."""
    group = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((entries["check"], group))
    checks, ids = entries["check"][order], entries["id"][order]
    edge = np.append(True, (np.diff(group[order]) != 0) | (np.diff(checks) != 0))
    begin = np.flatnonzero(edge)
    out = np.empty(len(order), bool)
    out[order] = not_first(begin, np.diff(np.append(begin, len(order))), ids)
    return out


def reports(entries: DataFrame, size: int, decide: Callable, width: int = 8, kind: str | np.dtype = "<i8") -> DataFrame:
    """What the fragments tell the blocks; ``size`` bytes of entries, about."""
    return dealt(entries, size, f"{P}fragment").groupBy(f"{P}fragment").applyInArrow(_report(width, kind, decide), REPORT)


def told(table: pa.Table, keys: np.ndarray, fragments: int) -> np.ndarray:
    """A byte for each of a block's distinct hashes, from the reports it got."""
    out, fragment = np.zeros(len(keys), np.uint8), _place(keys, fragments)
    names, (data, at) = table[f"{P}fragment"].to_numpy(), cells(table["told"])
    first, count = np.searchsorted(fragment, names), np.diff(at)
    if (np.searchsorted(fragment, names, "right") - first != count).any():
        raise ValueError("a report doesn't fit its block")
    out[ragged(first, count)] = data[ragged(at[:-1], count)]
    return out


def of_kind(found: pa.Table, kind: int) -> pa.Table:
    return found.filter(pc.equal(found["kind"], kind))
