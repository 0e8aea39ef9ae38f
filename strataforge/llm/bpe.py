"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Encoding: a task cuts its whole texts into pre-tokens and numbers the distinct ones of its block
(some hundred thousand words). Each word goes once per block to the bucket of its hash; a bucket
encodes each distinct word once and sends the ids back to the blocks that hold it; there they meet
the positions, and the documents' ids are put together again. What is shuffled is the distinct
words of blocks and a byte or two per pre-token, so no common word gathers anywhere.

Decoding joins the token-byte table, whose size the vocabulary bounds (a broadcast).

Defined cases: a null text is an empty one and has no ids; special tokens are never made from
text; a null or repeated id is carried through, row by row; an empty table gives an empty result;
other columns are not read. The rank file must be readable at its path on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import tiktoken

from strataforge.llm.pieces import PieceIndex, cells, unvarint, varint
from strataforge.llm.store import RID, P, dealt, identified, is_scan, partitions, total_bytes
from strataforge.llm.textcore import packed_rows, pretokens, ragged, slices

RANKS = "byte_bpe_50k.tiktoken"
#: A block ends at this many distinct words or bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 300_000, 32 << 20
#: Text for each bucket; its distinct words of all blocks are some tenths of that, in one task's memory.
BUCKET_BYTES = 128 << 20
_BLOCK = [f"{P}block_file", f"{P}block_row"]
_WORDS = f"{P}bucket int, {_BLOCK[0]} long, {_BLOCK[1]} long, numbers binary, sizes binary, words binary"
_PLACED = f"{_BLOCK[0]} long, {_BLOCK[1]} long, {RID[0]} array<long>, {RID[1]} array<long>, doc_id array<long>, pieces binary, positions binary"
_IDS = f"{_BLOCK[0]} long, {_BLOCK[1]} long, numbers binary, counts binary, ids binary"


@cache
def token_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_ranks(path), special_tokens={})


def _squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(varint(values)[0].tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    return unvarint(np.frombuffer(zlib.decompress(data), np.uint8))


def _blocks(batches: Iterator[pa.RecordBatch], words: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of each block by bucket, or (``words`` false) its documents' positions."""
    index, block, size, kept = PieceIndex(), None, 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        hashes, lengths, data = (np.concatenate(x) for x in zip(*kept, strict=True))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        parts: list[list[bytes]] = [[], [], []]
        for k in some.tolist():
            here = order[edge[k] : edge[k + 1]]  # ascending: small steps
            flat = data[ragged(start[edge[k] : edge[k + 1]], lengths[here])]
            for part, value in zip(parts, (_squeezed(np.diff(here, prepend=0)), _squeezed(lengths[here]), zlib.compress(flat.tobytes(), 1)), strict=True):
                part.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(np.full(len(some), x), pa.int64()) for x in block), *(pa.array(x, pa.binary()) for x in parts)], [x.split(" ")[0] for x in _WORDS.split(", ")])

    for batch in batches:
        file, row, doc_id, text = batch.columns
        for i, j, data, offsets in slices(text):
            if block is None or len(index) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                yield from flush()
                index, block, size, kept = PieceIndex(), (file[i].as_py(), row[i].as_py()), 0, []
            size += len(data)
            starts, first = pretokens(data, offsets)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            numbers, fresh, hashes = index.add(data, starts, ends)
            if words:
                lengths = (ends - starts)[fresh]
                kept.append((hashes[fresh], lengths, data[ragged(starts[fresh], lengths)]))
            else:
                ends_here = pa.array([0, j - i], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.int64()) for x in block), *(pa.ListArray.from_arrays(ends_here, c.slice(i, j - i)) for c in (file, row, doc_id)), pa.array([_squeezed(np.diff(first))], pa.binary()), pa.array([_squeezed(numbers)], pa.binary())],
                    [x.split(" ")[0] for x in _PLACED.split(", ")],
                )
    yield from flush()


def _encode_bucket(path: str, pattern: str, kind: str):  # noqa: ANN202
    def encode(table: pa.Table) -> pa.Table:
        encoder, known, counts, ids = _encoder(path, pattern), {}, [], []
        for sizes, words in zip(table["sizes"].to_pylist(), table["words"].to_pylist(), strict=True):
            text = zlib.decompress(words)
            ends = np.cumsum(_unsqueezed(sizes)).tolist()
            row, start = [], 0
            for end in ends:
                word = text[start:end]
                start = end
                found = known.get(word)
                if found is None:
                    found = known[word] = encoder.encode_ordinary(word.decode())
                row.append(found)
            counts.append(_squeezed(np.fromiter(map(len, row), np.int64, len(row))))
            ids.append(zlib.compress(np.fromiter((x for w in row for x in w), kind).tobytes(), 1))
        return table.select([*_BLOCK, "numbers"]).append_column("counts", pa.array(counts, pa.binary())).append_column("ids", pa.array(ids, pa.binary()))

    return encode


def _reassemble(kind: str):  # noqa: ANN202
    def reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        held = {c: words[c].to_pylist() for c in ("numbers", "counts", "ids")}
        number = np.concatenate([np.cumsum(_unsqueezed(x)) for x in held["numbers"]] or [np.zeros(0, np.int64)])
        count = np.concatenate([_unsqueezed(x) for x in held["counts"]] or [np.zeros(0, np.int64)])
        flat = np.frombuffer(b"".join(map(zlib.decompress, held["ids"])), kind)
        size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        size[number], start[number] = count, np.cumsum(count) - count
        out = []
        for k in range(len(docs)):
            rows = [docs[c].combine_chunks().slice(k, 1).flatten() for c in (*RID, "doc_id")]
            place = _unsqueezed(docs["positions"][k].as_py())
            done = np.concatenate(([0], np.cumsum(_unsqueezed(docs["pieces"][k].as_py()))))
            lengths = size[place]
            ids = flat[ragged(start[place], lengths)].astype("<u4")
            total = np.concatenate(([0], np.cumsum(lengths)))[done]
            out.append(pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(total), pa.int64()), packed_rows(np.diff(total), ids)], [*RID, "doc_id", "n_tokens", "ids"]))
        return pa.Table.from_batches(out) if out else pa.table({RID[0]: pa.array([], pa.int64()), RID[1]: pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})

    return reassemble


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", *, scan: bool | None = None) -> DataFrame:
    """Row identity, doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""
    scan = is_scan(docs) if scan is None else scan
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(["_metadata"] if scan else [])), "doc_id", "text", scan=scan).select(*RID, "doc_id", "text")
    kind = "<u2" if max(token_ranks(ranks_path).values()) < 1 << 16 else "<u4"
    size = total_bytes(rows, "text")
    buckets = max(4 * partitions(docs.sparkSession), size // BUCKET_BYTES + 1)
    # both sides come from the same deterministic pass over the same splits: cutting text again is
    # cheaper than keeping positions until the ids are back. Words are numbered as they first appear,
    # so blocks that ended elsewhere the second time would lack words, and the task would fail
    words = dealt(rows.mapInArrow(lambda it: _blocks(it, True, buckets), _WORDS), size // 4, f"{P}bucket")
    ids = dealt(words.groupBy(f"{P}bucket").applyInArrow(_encode_bucket(ranks_path, pattern, kind), _IDS), size, *_BLOCK)
    placed = dealt(rows.mapInArrow(lambda it: _blocks(it, False, buckets), _PLACED), size, *_BLOCK)
    return placed.groupBy(*_BLOCK).cogroup(ids.groupBy(*_BLOCK)).applyInArrow(_reassemble(kind), f"{RID[0]} long, {RID[1]} long, doc_id long, n_tokens long, ids binary")


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = token_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    flat = b"".join(sorted(ranks, key=ranks.__getitem__))
    return np.frombuffer(flat, np.uint8), np.cumsum(size) - size, size


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with a column ids) with ``decoded``: the bytes of the tokens, one after another."""
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, size = _token_bytes(ranks_path)
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                data, offsets = cells(batch.column(batch.schema.get_field_index("ids")))
                ids = np.ascontiguousarray(data).view("<u4").astype(np.int64)
                total = np.concatenate(([0], np.cumsum(size[ids])))[offsets // 4]
                yield pa.RecordBatch.from_arrays([*batch.columns, packed_rows(np.diff(total), flat[ragged(start[ids], size[ids])])], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as checksums."""
    path = public_tokenizers.path(RANKS)
    encoded = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, scan=True)
    return bpe_decode(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
