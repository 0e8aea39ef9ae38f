"""Spelling variant grouping: words one edit apart, found by probing Bloom filters of the vocabulary.

Words are counted with partial sums before the shuffle. Each word's edits (each letter deleted, each letter
replaced by a later one of the vocabulary's letters; so that of two near words one generates the other) are
hashed without being spelled out, and probe blocked Bloom filters sharded by length: a filter's block is one
64-bit number of 16 bits a word. Filters are built where a shard's hashes meet and broadcast in turns of
``FILTER_BYTES`` at most, whatever the vocabulary's size; a large length has several shards. Only positives
are shuffled, to an exact join with the vocabulary: by hash first, then the edit is applied to the word and must
spell the other one, which leaves no false positive.

A word's form is its most frequent near word where that is ``RATIO`` times as frequent; roots follow forms by
pointer jumping. A form is always more frequent than the word, so there are no cycles.

Defined cases: a null text has no runs; a null id counts as an empty one in the checksum; letters are
``[A-Za-z\\u00C0-\\u00FF]`` in any length of run (a word takes memory in proportion to its letters); repeated rows
count as often as they stand; ties go to the first form in code-point order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.store import P, materialize
from strataforge.llm.textcore import LOWER, U, mix, packed_rows, ragged, slices, stretches

#: Least letters and occurrences of a word, one in so many checksums loses a letter, and how much more frequent a form is.
LETTERS, OCCURRENCES, FAULTY, RATIO = 7, 2, 31, 10
#: Words of a filter's shard, bits of a word, and bytes of the filters that are broadcast at once.
SHARD_WORDS, WORD_BITS, FILTER_BYTES = 1 << 20, 16, 64 << 20
#: Bytes of words that a task counts at once, letters that it probes at once, and runs beyond this many bytes go one by one.
_HELD, _PROBED, _LONG = 16 << 20, 1 << 20, 64
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_C3 = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the crc32 in ``seeds``: a byte of all spans at a time."""
    order = np.argsort(sizes, kind="stable")
    starts, sizes, state = starts[order], sizes[order], ~seeds[order]
    end = int(np.searchsorted(sizes, _LONG, "right"))
    for k in range(int(sizes[end - 1]) if end else 0):
        low = np.searchsorted(sizes[:end], k, "right")
        now = state[low:end]
        state[low:end] = _CRC[(now ^ data[starts[low:end] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order[:end]] = ~state[:end]
    for k in range(end, len(order)):
        out[order[k]] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(seeds[order[k]]))
    return out


def counted_runs(ids: list, first: int, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The words of a slice of texts (rows ``first`` and on of ``ids``), each as often as it stands."""
    data = LOWER[data]
    lead = data == _C3
    inside = _ALPHA[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, of = stretches(inside, offsets)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    size = points[ends] - points[starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    enough = size >= LETTERS
    starts, ends, size, text = starts[enough], ends[enough], size[enough], text[enough]
    prefix = np.array([zlib.crc32(f"{'' if ids[first + k] is None else ids[first + k]}:".encode()) for k in range(len(offsets) - 1)], np.uint32)
    crc = checksums(data, starts, ends - starts, prefix[text])
    faulty = crc % FAULTY == 0
    whole = ~faulty
    out = [packed_rows(ends[whole] - starts[whole], data[ragged(starts[whole], ends[whole] - starts[whole])])]
    faulty &= size > LETTERS
    if faulty.any():
        starts, ends, size, crc = starts[faulty], ends[faulty], size[faulty], crc[faulty]
        gone = np.flatnonzero((data & 0xC0) != 0x80)[points[starts] + crc % size]
        width = 1 + (data[gone] == _C3)
        at, row = ragged(starts, ends - starts), np.repeat(np.arange(len(starts)), ends - starts)
        stay = (at < gone[row]) | (at >= (gone + width)[row])
        out.append(packed_rows(ends - starts - width, data[at[stay]]))
    return pa.concat_arrays(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        found = pc.value_counts(pa.concat_arrays(held))
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, _, data, offsets in slices(batch.column(1)):
            held.append(counted_runs(ids, i, data, offsets))
            size += held[-1].nbytes
            if size >= _HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte per letter of all words (their code points), and where each word begins."""
    text = "\n".join(column.to_pylist()).encode("latin-1")
    data = np.frombuffer(text + b"\n", np.uint8)
    return data, np.concatenate(([0], np.flatnonzero(data == 10) + 1))


def _g(at: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A number for a letter at a place; a word's hash mixes the sum of its letters' numbers."""
    return mix(at.astype(U) * U(256) + letter.astype(U) + U(0x51))


def _hash(total: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    return mix(total + np.asarray(size).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words and their numbers of letters."""
    if not len(column):
        return np.zeros(0, U), np.zeros(0, np.int64)
    data, start = _letters(column)
    size = np.diff(start) - 1
    at = np.arange(len(data)) - np.repeat(start[:-1], size + 1)
    number = np.where(data == 10, U(0), _g(at, data))
    return _hash(np.add.reduceat(number, start[:-1]), size), size


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, size = word_hashes(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(hashes.view(np.int64))], ["word", "n", "size", "hash"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(256, bool)
    for batch in batches:
        if len(batch):
            seen[_letters(batch.column(0))[0]] = True
    seen[10] = False
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["letter"])


class Filters:
    """Blocked Bloom filters of some shards: (length, shard) -> 64-bit blocks; ``shards`` is each length's number of shards."""

    def __init__(self, shards: dict[int, int], blocks: dict[tuple[int, int], np.ndarray]) -> None:
        self.shards, self.blocks = shards, blocks

    @staticmethod
    def shard(hashes: np.ndarray, shards: int) -> np.ndarray:
        return ((hashes >> U(32)) * U(shards)) >> U(32)

    @staticmethod
    def place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and four bits in it of each hash."""
        again = mix(hashes ^ U(0xA5A5A5A5A5A5A5A5))
        bits = (U(1) << (again & U(63))) | (U(1) << ((again >> U(6)) & U(63))) | (U(1) << ((again >> U(12)) & U(63))) | (U(1) << ((again >> U(18)) & U(63)))
        return ((again >> U(32)) * U(blocks)) >> U(32), bits

    @classmethod
    def build(cls, hashes: np.ndarray) -> np.ndarray:
        blocks = np.zeros(len(hashes) * WORD_BITS // 64 + 1, U)
        at, bits = cls.place(hashes, len(blocks))
        np.bitwise_or.at(blocks, at.astype(np.int64), bits)
        return blocks

    def positive(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the hashes that words of ``size`` letters in these shards may have."""
        count = self.shards.get(size, 0)
        out = []
        for shard in range(count):
            blocks = self.blocks.get((size, shard))
            if blocks is None:
                continue
            mine = np.arange(len(hashes)) if count == 1 else np.flatnonzero(self.shard(hashes, count) == shard)
            at, bits = self.place(hashes[mine], len(blocks))
            out.append(mine[(blocks[at.astype(np.int64)] & bits) == bits])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def edit_hashes(words: np.ndarray, letters: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of words of equal length (a byte per letter): (length of the edit, letter or 0, word numbers, places, hashes) of all edits.

    Deletions come once for each run of equal letters, replacements for later letters only.
    """
    n, size = words.shape
    at = np.arange(size)
    here, total = _g(at, words), np.zeros((n, size + 1), U)
    np.cumsum(here, axis=1, out=total[:, 1:])
    moved = np.zeros((n, size + 1), U)
    np.cumsum(_g(at[:-1], words[:, 1:]), axis=1, out=moved[:, 2:])  # numbers of the letters from 1 on, one place to the left
    last = np.append(words[:, :-1] != words[:, 1:], np.ones((n, 1), bool), axis=1)
    row, place = np.nonzero(last)
    yield size - 1, 0, row, place, _hash(total[row, place] + moved[:, -1][row] - moved[row, place + 1], size - 1)
    rest = total[:, -1][:, None] - here
    for letter in letters:
        row, place = np.nonzero(words < letter)
        yield size, letter, row, place, _hash(rest[row, place] + _g(at, np.full(size, letter))[place], size)


_FOUND = "id long, hash long, place int, letter int"


def _probe(filters, letters: list[int]) -> Callable:  # noqa: ANN001
    """Rows (id, word) to the edits that ``filters`` (a broadcast) don't rule out."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Filters = filters.value
        for batch in batches:
            if not len(batch):
                continue
            ids, (data, start) = batch.column(0).to_numpy(), _letters(batch.column(1))
            sizes = np.diff(start) - 1
            for size in np.unique(sizes):
                mine, step = np.flatnonzero(sizes == size), max(1, _PROBED // int(size))
                for low in range(0, len(mine), step):
                    some = mine[low : low + step]
                    words = data[start[some][:, None] + np.arange(size)]
                    for length, letter, row, place, hashes in edit_hashes(words, letters):
                        hit = held.positive(hashes, length)
                        if len(hit):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[some[row[hit]]]), pa.array(hashes[hit].view(np.int64)), pa.array(place[hit].astype(np.int32)), pa.array(np.full(len(hit), letter, np.int32))], ["id", "hash", "place", "letter"])

    return probe


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that stand ``OCCURRENCES`` times or more."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b, a_word, b_word, a_n, b_n) one edit apart, each once, of a written ``vocabulary`` (id, word, n, size, hash)."""
    spark = vocabulary.sparkSession
    counts = {r.size: r.words for r in vocabulary.groupBy("size").agg(F.count("*").alias("words")).collect()}  # a row per length
    shards = {size: -(-words // SHARD_WORDS) for size, words in counts.items()}
    letters = sorted(r.letter for r in vocabulary.select("word").mapInArrow(_spelled, "letter int").distinct().collect())  # 90 at most

    def build(table: pa.Table) -> pa.Table:
        blocks = Filters.build(table["hash"].to_numpy().view(U))
        return table.select(["size", "shard"]).slice(0, 1).append_column("blocks", pa.array([blocks.tobytes()], pa.binary()))

    number = F.create_map(*(F.lit(x).cast("long") for pair in shards.items() for x in pair)) if shards else F.create_map(F.lit(0).cast("long"), F.lit(1))
    shard = F.expr("shiftright(shiftrightunsigned(hash, 32) * shards, 32)")
    placed = vocabulary.select("size", "hash", number[F.col("size")].cast("long").alias("shards")).select("size", "hash", shard.cast("int").alias("shard"))
    built = materialize(placed.groupBy("size", "shard").applyInArrow(build, "size long, shard int, blocks binary"), "filters")
    todo, found = [(size, shard) for size in sorted(shards) for shard in range(shards[size])], []
    while todo:
        turn, size = [], 0
        while todo and (not turn or size + counts[todo[0][0]] // shards[todo[0][0]] * WORD_BITS // 8 <= FILTER_BYTES):
            turn.append(todo.pop(0))
            size += counts[turn[-1][0]] // shards[turn[-1][0]] * WORD_BITS // 8
        lengths = sorted({x for x, _ in turn})
        rows = built.where(F.col("size").between(lengths[0], lengths[-1])).where(F.struct("size", "shard").isin([F.struct(F.lit(a).cast("long"), F.lit(b)) for a, b in turn]))
        held = spark.sparkContext.broadcast(Filters(shards, {(r.size, r.shard): np.frombuffer(r.blocks, U) for r in rows.collect()}))  # FILTER_BYTES
        asking = vocabulary.where(F.col("size").isin(sorted({*lengths, *(x + 1 for x in lengths)}))).select("id", "word")
        found.append(materialize(asking.mapInArrow(_probe(held, letters), _FOUND), "positives"))
    if not found:
        return spark.createDataFrame([], "a long, b long, a_word string, b_word string, a_n long, b_n long")
    positives = found[0]
    for more in found[1:]:
        positives = positives.union(more)
    met = positives.withColumnRenamed("id", "a").join(vocabulary.select("hash", F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n")), "hash")
    met = met.join(vocabulary.select(F.col("id").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n")), "a")
    spelled = F.expr("concat(substring(a_word, 1, place), if(letter = 0, '', chr(letter)), substring(a_word, place + 2))")
    return met.where(F.col("b_word") == spelled).select("a", "b", "a_word", "b_word", "a_n", "b_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = word_counts(docs, id_col, text_col).mapInArrow(_hashed, "word string, n long, size long, hash long")
    vocabulary = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = materialize(near_words(vocabulary), "near")
    one = pairs.select(F.col("a").alias("id"), F.col("a_n").alias("own"), F.struct((-F.col("b_n")).alias("less"), F.col("b_word").alias("word"), F.col("b").alias("id")).alias("near"))
    other = pairs.select(F.col("b").alias("id"), F.col("b_n").alias("own"), F.struct((-F.col("a_n")).alias("less"), F.col("a_word").alias("word"), F.col("a").alias("id")).alias("near"))
    best = one.union(other).groupBy("id").agg(F.count("*").alias("n_near"), F.min("near").alias("near"), F.min("own").alias("own"))
    is_form = -F.col("near.less") >= RATIO * F.col("own")
    best = materialize(best.select("id", "n_near", *(F.when(is_form, F.col(f"near.{c}")).alias(f"form_{c}") for c in ("word", "id", "less"))), "forms")
    roots = materialize(best.where("form_id is not null").select("id", F.col("form_id").alias("top"), F.col("form_word").alias("root")), "roots")
    while True:  # chains are logarithmic in the largest count, and jumps in the chains
        above = roots.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("root").alias("next_root"))
        roots = materialize(roots.join(above, "top", "left").select("id", F.coalesce("next", "top").alias("top"), F.coalesce("next_root", "root").alias("root"), F.col("next").isNotNull().alias(f"{P}moved")), "roots")
        if roots.where(f"{P}moved").isEmpty():
            break
    out = vocabulary.select("id", "word", "n").join(best, "id", "left").join(roots.select("id", "root"), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("form_less")).alias("form_n"))


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
