"""Vectorised text kernels over Arrow string batches: words, pre-tokens, rolling hashes.

They work on the bytes of many documents at once (numpy inside a Spark task); a batch is cut
into slices of bounded bytes, so that memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken

U = np.uint64
SLICE = 1 << 20
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``most`` bytes."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of ``x`` reaches every bit of the result."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of ``data`` on, as numbers (zeros beyond its end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_chunks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk of eight bytes of each span, the further chunks of all spans, and their number for each."""
    eight = _eights(data)
    more = np.maximum(sizes - 1, 0) // 8
    row, number = np.repeat(np.arange(len(sizes)), more), 1 + ragged(np.zeros(len(sizes), np.int64), more)
    rest = eight[starts[row] + 8 * number] & _KEEP[np.minimum(sizes[row] - 8 * number, 8)]
    return eight[starts] & _KEEP[np.minimum(sizes, 8)], rest, more


def chunk_hashes(first: np.ndarray, rest: np.ndarray, more: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans given as ``span_chunks``; another ``seed`` gives other hashes, independent of the first.

    Every chunk of eight bytes is mixed with its place in the span before they are added up, so
    that no pattern in a span's bytes (as with powers of one base) makes spans alike.
    """
    seed = U(seed)
    out = mix((first ^ seed) + U(0x632BE59BD9B4E019))
    if len(rest):
        number = 1 + ragged(np.zeros(len(more), np.int64), more)
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(rest ^ mix(number.astype(U) + seed)), dtype=U)))
        end = np.cumsum(more)
        out += total[end] - total[end - more]
    return mix(out + sizes.astype(U) * U(0xD6E8FEB86659FD93) + seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[starts:ends]``: equal spans hash equally wherever they stand."""
    sizes = ends - starts
    return chunk_hashes(*span_chunks(data, starts, sizes), sizes, seed)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * U(0x9E3779B97F4A7C15) + right
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` values from each of ``at`` on: parts of a power of two values are joined and mixed."""
    if not len(at):
        return np.zeros(0, U)
    level, width, out, offset = hashes, 1, None, 0
    while True:
        if size & width:
            part = level[at + offset]
            out, offset = part if out is None else _join(out, part), offset + width
        if size < 2 * width:
            return mix(out + U(size))
        level, width = _join(level[:-width], level[width:]), 2 * width


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stretches(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of ``inside`` bytes of one text, and each text's first run number."""
    starts_here, ends_here = inside.copy(), inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(inside))]
    starts_here[edges] = inside[edges]
    ends_here[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word number."""
    return stretches(~_SPACE[data], offsets)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a window of ``k`` words of one text starts, and its text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(text)) + (first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else first[:0])[text], text


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


@cache
def _classes() -> np.ndarray:
    """Code point classes: 1 letter, 2 number, 3 white space, 0 anything else, as the tokenizer library has them.

    Libraries know different versions of Unicode. The one whose pieces are wanted is asked itself:
    a vocabulary of single bytes and a pattern of one class give back the characters of the class.
    """
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(one.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = kind
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of the pre-tokens of all texts and each text's first pre-token number.

    The pieces are the matches of ``public_tokenizers.PATTERN``, which cover a text without a
    gap: an optional space before a run of letters, numbers or others; contractions; white space.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.searchsorted(lead, offsets)
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    run = begins.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    # a run that isn't white space takes over the last white space character before it
    body = np.flatnonzero(run[:n] & (kind != 3) & ~begins[:n])
    body = body[kind[body - 1] == 3]
    start[body - 1] = True
    spaced = body[points[body - 1] == 0x20]
    start[spaced] = False
    # contractions: an apostrophe that starts a piece, alone in its run, before certain letters
    quote = np.flatnonzero((points == 0x27) & start & ~begins[1:])
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, np.uint32)))
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~begins[np.minimum(quote + 2, n)]
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    found = np.flatnonzero(start)
    return lead[found], np.searchsorted(found, first)


def packed_rows(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of the next ``lengths[i]`` values."""
    offsets = np.concatenate(([0], np.cumsum(lengths * values.itemsize))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
