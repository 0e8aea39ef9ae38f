"""Substring deduplication with a sparse suffix array.

Suffixes are retained only at minimiser positions: of every ``LENGTH - GRAM + 1`` consecutive word
windows of ``GRAM`` words the one with the least hash. The text alone selects them, so two equal
stretches of ``LENGTH`` words hold the same one. All suffixes are sorted over range partitions and
compared with their neighbours (those astride a partition's edge included): what a suffix shares
with a neighbour is the longest match to the right that it has with any other. To the left a match
that counts extends no further than a window of ``LENGTH`` words reaches. Windows of ``LENGTH``
words within such a stretch are then compared exactly, since the neighbour to the right need not be
the match to the left; of equal windows only those in the document with the smallest id stay.

Suffixes are compared by 16-bit word codes over the ``LENGTH`` words that a window can hold, which
can only lengthen a match before the exact step, and windows by two independent 64-bit hashes. Defined cases: a null
text has no words; a null id comes after every id; repeats within one id stay; texts of fewer than
``LENGTH`` words keep all; an empty table gives an empty result; other columns are carried only
where asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.llm.blocks import BLOCK, ID, SLOT, TEXT, Words, blocked, of_kind
from strataforge.llm.pieces import cells
from strataforge.llm.store import PART_BYTES, materialize, partitions
from strataforge.llm.substrings import OP10_SQL, digests, remove_repeats, starts_in
from strataforge.llm.textcore import packed_rows, ragged, slices, span_hashes, window_hashes, windows, words

LENGTH, GRAM = 50, 8
_SUFFIX = f"right binary, id long, {BLOCK} long, {SLOT} int, at int"
_NAMES = [x.split(" ")[0] for x in _SUFFIX.split(", ")]
_OUT = f"kind int, part int, {_SUFFIX}, length int"


def minimisers(first: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the selected positions, their texts and their window hashes."""
    at, text = windows(first, gram)
    grams = window_hashes(hashes, at, gram)
    width = length - gram + 1
    begin, _ = windows(np.searchsorted(text, np.arange(len(first))), width)
    if not len(begin):
        return at[:0], text[:0], grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, width)[begin].argmin(axis=1) if len(begin) < 1 << 14 else np.concatenate([np.lib.stride_tricks.sliding_window_view(grams, width)[begin[c : c + (1 << 14)]].argmin(axis=1) for c in range(0, len(begin), 1 << 14)])
    chosen = np.unique(begin + least)
    return at[chosen], text[chosen], grams[chosen]


def _suffixes(length: int, gram: int) -> Callable:
    """The codes of the words from each minimiser on."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([ID, BLOCK, SLOT])
            for i, _, data, offsets in slices(batch.column(0)):
                starts, ends, first = words(data, offsets)
                hashes = span_hashes(data, starts, ends)
                at, text, _ = minimisers(first, hashes, length, gram)
                right = np.minimum(length, first[text + 1] - at)
                codes = (hashes >> np.uint64(48)).astype(">u2")
                yield pa.RecordBatch.from_arrays([packed_rows(right, codes[ragged(at, right)]), *rows.take(pa.array(i + text)).columns, pa.array((at - first[text]).astype(np.int32))], _NAMES)

    return suffixes


def _common(column: pa.Array) -> np.ndarray:
    """Common leading codes of each row and the next one, of a column of packed codes."""
    data, offsets = cells(column)
    codes, size = np.ascontiguousarray(data).view(">u2"), np.diff(offsets) // 2
    wide = np.full((len(size), int(size.max(initial=0)) + 1), -1, np.int32)
    wide[np.repeat(np.arange(len(size)), size), ragged(np.zeros(len(size), np.int64), size)] = codes
    differ = np.concatenate((wide[:-1] != wide[1:], np.ones((len(size) - 1, 1), bool)), axis=1).argmax(axis=1)
    return np.minimum(differ, np.minimum(size[:-1], size[1:]))


def _rows(batch: pa.RecordBatch, kind: int, part: int, row: np.ndarray, start: np.ndarray, size: np.ndarray, right: pa.Array | None) -> pa.RecordBatch:
    """Rows of kind 0 (a stretch of words: at, length) or 1 (a partition's outermost suffixes)."""
    take = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(row), kind), pa.int32()), pa.array(np.full(len(row), part), pa.int32()), pa.nulls(len(row), pa.binary()) if right is None else right, *take.columns[1:4], pa.array(start, pa.int32()), pa.array(size, pa.int32())],
        ["kind", "part", *_NAMES, "length"],
    )


def _found(batch: pa.RecordBatch, part: int, length: int, gram: int) -> pa.RecordBatch:
    """Stretches around suffixes that can hold a window of ``length`` words their neighbour has too."""
    common, at = _common(batch.column(0)), batch.column(4).to_numpy()
    row = np.concatenate((np.arange(len(common)), np.arange(len(common)) + 1))
    right = np.concatenate((common, common))
    left = np.minimum(at[row], length - gram)
    fits = left + right >= length
    row, left, right = row[fits], left[fits], right[fits]
    return _rows(batch, 0, part, row, at[row] - left, left + right, None)


def _neighbours(length: int, gram: int) -> Callable:
    def edge(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
        return _rows(batch, 1, part, np.array([0]), batch.column(4).to_numpy()[:1], np.array([0]), batch.column(0).slice(0, 1))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for whole in batches:
            for c in range(0, len(whole), 4096):
                batch = whole.slice(c, 4096)
                if last is None:
                    yield edge(batch, part)
                else:
                    batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                yield _found(batch, part, length, gram)
                last = batch.slice(len(batch) - 1)
        if last is not None:
            yield edge(last, part)

    return neighbours


def _across(length: int, gram: int) -> Callable:
    """Each row holds the last suffix of a partition and the first of the next one."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = len(_NAMES)
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                pair = pa.Table.from_batches([pa.RecordBatch.from_arrays(one.columns[c : c + half], _NAMES) for c in (0, half)]).combine_chunks().to_batches()[0]
                yield _found(pair, 0, length, gram)

    return across


def matched_stretches(suffixes: DataFrame, size: int, length: int, gram: int) -> DataFrame:
    """Stretches (block, slot, at, length) that hold every window of ``length`` words that repeats."""
    parts = max(partitions(suffixes.sparkSession), size // PART_BYTES + 1)
    ordered = suffixes.repartitionByRange(parts, *_NAMES).sortWithinPartitions(*_NAMES)
    found = materialize(ordered.mapInArrow(_neighbours(length, gram), _OUT), "neighbours")
    # two rows of each range partition: its first and its last suffix
    edges = found.where("kind = 1").select("part", *_NAMES)
    along = Window.orderBy("part", *_NAMES)
    beyond = edges.select("*", F.lead("part").over(along).alias("next"), *(F.lead(c).over(along).alias(f"next_{c}") for c in _NAMES))
    astride = beyond.where("next > part").select(*_NAMES, *(f"next_{c}" for c in _NAMES)).mapInArrow(_across(length, gram), _OUT)
    return found.where("kind = 0").union(astride).groupBy(BLOCK, SLOT, "at").agg(F.max("length").alias("length"))


def _within(length: int) -> Callable:
    """Of a block's slices: starts of the windows that lie within a stretch."""

    def locate(parts: list[Words], docs: pa.Table, found: pa.Table) -> list[np.ndarray]:
        stretches = of_kind(found, 0)
        slots, at, size = (stretches[c].to_numpy().astype(np.int64) for c in (SLOT, "at", "length"))
        row, out = np.full(1 << 16, -1), []
        row[docs[SLOT].to_numpy()] = np.arange(len(docs))
        row = row[slots]
        for part in parts:
            here = (row >= part.row) & (row < part.row + len(part.first) - 1)
            text = row[here] - part.row
            begin = part.first[text] + at[here]
            out.append(starts_in(part, text, begin, begin + size[here] - length + 1, length))
        return out

    return locate


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: _sf_id, _sf_text, ``carry`` and ``substrings.RESULT``."""
    if not 0 < gram < length:
        raise ValueError("gram must be positive and less than length")
    blocks, size = blocked(docs, id_col, text_col, carry or [])
    suffixes = blocks.select(TEXT, ID, BLOCK, SLOT).mapInArrow(_suffixes(length, gram), _SUFFIX)
    stretches = materialize(matched_stretches(suffixes, size, length, gram).withColumn("kind", F.lit(0)), "stretches")
    return remove_repeats(blocks, size, stretches, length, _within(length), carry or [])


def op8_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word stretches that start in an earlier document."""
    return digests(suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The definition without minimisers: windows of 50 words in place of 13.
OP8_SQL = OP10_SQL.replace("len(w) - 11", "len(w) - 48").replace("i + 12", "i + 49").replace("len(w) >= 13", "len(w) >= 50").replace("range(0, 13)", "range(0, 50)")
