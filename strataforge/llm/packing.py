"""Packing along a space-filling curve: similar documents share sequences, almost without padding.

A document's token counts, hashed to a vector, are projected to four dimensions by fixed random
signs; the Hilbert key of that point orders all documents (range sort, ties by row identity). The
documents' tokens, laid along the curve, are cut every ``length`` tokens; only the last sequence
can be short. Offsets come from sums per range partition, so nothing gathers in one task.

Defined cases: a null text is an empty one (a single end token); rows are told apart by their
identity, so repeated or null ids are packed row by row; an empty table gives an empty result;
other columns are not read. The tokenizer file must be readable at its path on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import pairwise
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.pieces import Grown, PieceIndex, cells
from strataforge.llm.store import RID, P, identified, is_scan, materialize, partitions
from strataforge.llm.textcore import mix, packed_rows, pretokens, ragged, slices

TOKENIZER = "byte_bpe_50k.json"
DIMENSIONS, BITS = 4, 12
#: Encoded words that a task remembers; then it forgets them all.
REMEMBERED = 600_000
_END = 0


class _Encoder:
    """Ids of whole texts through the distinct pre-tokens of a slice, each encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.index, self.flat, self.at, self.size = PieceIndex(), Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and each text's number of ids; a text that holds an added token is left to the library."""
        raw, edges = data.tobytes(), {0, len(offsets) - 1}
        marked = self._marked(raw, offsets)
        for k in marked:
            edges |= {k, k + 1}
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in pairwise(sorted(edges)):
            if a in marked:
                found = self.tokenizer.encode(raw[offsets[a] : offsets[b]].decode(), add_special_tokens=False).ids
                part = np.array(found, np.uint32), np.array([len(found)], np.int64)
            else:
                part = self._pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(part[0])
            counts.append(part[1])
        return np.concatenate(ids), np.concatenate(counts)

    def _marked(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """The texts in which an added token stands (the library cuts there first)."""
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[text + 1]:
                    found.add(text)
                    at = raw.find(token, int(offsets[text + 1]))
                else:
                    at = raw.find(token, at + 1)
        return found

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.forget()
        starts, first = pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        numbers, fresh, _ = self.index.add(data, starts, ends)
        if len(fresh):
            raw = data.tobytes()
            found = self.tokenizer.encode([raw[a:b].decode() for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)], is_pretokenized=True, add_special_tokens=False)
            size = np.bincount(np.array(found.word_ids, np.int64), minlength=len(fresh))
            self.at.append(len(self.flat) + np.cumsum(size) - size)
            self.size.append(size)
            self.flat.append(np.array(found.ids, np.uint32))
        lengths = self.size.values[numbers]
        total = np.concatenate(([0], np.cumsum(lengths)))[first]
        return self.flat.values[ragged(self.at.values[numbers], lengths)], np.diff(total)


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (dimensions x n) below 2**bits."""
    x, one = points.astype(np.uint64).copy(), np.uint64(1)
    for q in (np.uint64(1 << k) for k in range(bits - 1, 0, -1)):
        low = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for q in (np.uint64(1 << k) for k in range(bits - 1, 0, -1)):
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text: its mean token direction under fixed random signs."""
    points = np.zeros((DIMENSIONS, len(counts)), np.uint64)
    at, some = np.cumsum(counts) - counts, counts > 0
    for d in range(DIMENSIONS):
        signs = (mix(ids.astype(np.uint64) + np.uint64(0x51ED * (d + 1) << 32)) & np.uint64(1)).astype(np.float64) * 2 - 1
        mean = np.zeros(len(counts))
        if len(ids):
            mean[some] = np.add.reduceat(signs, at[some]) / counts[some]
        points[d] = np.clip((1 + np.tanh(2 * mean)) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.uint64)
    return hilbert_keys(points, BITS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", *, scan: bool | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    scan = is_scan(docs) if scan is None else scan
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(["_metadata"] if scan else [])), "doc_id", "text", scan=scan).select(*RID, "doc_id", "text")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(3)):
                ids, counts = encoder.encode(data, offsets)
                kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(counts + 1), pa.array(curve_keys(ids, counts)), pa.array(np.full(j - i, int(kind[2])), pa.int32()), packed_rows(counts, ids.astype(kind))], [*RID, "doc_id", "doc_tokens", f"{P}key", f"{P}width", "ids"])

    tokens = materialize(rows.mapInArrow(tokenize, f"{RID[0]} long, {RID[1]} long, doc_id long, doc_tokens long, {P}key long, {P}width int, ids binary"), "tokens")
    order = [f"{P}key", *RID]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = done + np.cumsum(batch.column(2).to_numpy())
            begins = np.concatenate(([done], ends[:-1]))
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(batch), part), pa.int32()), pa.array(begins, pa.int64())], [*RID, "doc_tokens", f"{P}part", f"{P}local"])

    curve = tokens.select(f"{P}key", *RID, "doc_tokens").repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    local = materialize(curve.select(*RID, "doc_tokens").mapInArrow(place, f"{RID[0]} long, {RID[1]} long, doc_tokens long, {P}part int, {P}local long"), "curve")
    base = local.groupBy(f"{P}part").agg(F.sum("doc_tokens").alias("t")).selectExpr(f"{P}part", f"coalesce(sum(t) over (order by {P}part rows between unbounded preceding and 1 preceding), 0) as {P}base")
    starts = materialize(local.join(F.broadcast(base), f"{P}part").select(*RID, (F.col(f"{P}base") + F.col(f"{P}local")).alias(f"{P}at")), "starts")  # base: a row per range partition

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                doc_id, tokens, width, at = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(4).to_numpy()
                data, offsets = cells(batch.column(3))
                first, pieces = at // length, (at + tokens - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(batch)), pieces)
                sequence = ragged(first, pieces)
                begin = np.maximum(sequence * length, at[doc])
                end = np.minimum((sequence + 1) * length, at[doc] + tokens[doc])
                ids = [np.append(data[offsets[x] : offsets[x + 1]].view(f"<u{width[x]}"), [_END]).astype("<u4") for x in range(len(batch))]
                parts = [ids[d][b:e] for d, b, e in zip(doc.tolist(), (begin - at[doc]).tolist(), (end - at[doc]).tolist(), strict=True)]
                out = [pa.array([doc_id[d] for d in doc.tolist()], pa.int64()), pa.array(begin - at[doc]), pa.array(end - begin), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(tokens[doc]), pa.array(sequence), pa.array(begin - sequence * length)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(out + ([pa.array([x.tobytes() for x in parts], pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    joined = tokens.join(starts.hint("merge"), RID).select("doc_id", "doc_tokens", f"{P}width", "ids", f"{P}at")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER), scan=True, with_ids=False)
