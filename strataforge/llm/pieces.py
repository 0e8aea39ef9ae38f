"""Numbering of distinct pre-tokens, and small integer packings (numpy, inside a task)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strataforge.llm.textcore import chunk_hashes, mix, ragged, span_chunks, text_buffer


class Grown:
    """An array that is appended to: its room doubles, so that growing it seldom copies."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.size

    def append(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class PieceIndex:
    """Numbers 0, 1, ... for distinct byte strings, in order of first appearance.

    A hash finds a string's place and its bytes decide: a string whose hash another one holds
    moves on to the next hash of its own. A direct table answers for most strings already known.
    """

    BITS = 18

    def __init__(self) -> None:
        # sorted hashes and their numbers: most of them, and those that came lately
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known, self.lately = none, none
        # of each number: bytes in all, first eight bytes, and where its further chunks begin
        self.sizes, self.first, self.at, self.rest = Grown(np.int64), Grown(np.uint64), Grown(np.int64), Grown(np.uint64)
        self.table = np.full(1 << self.BITS, -1, np.int32)

    def __len__(self) -> int:
        return len(self.sizes)

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the spans ``data[starts:ends]``: their numbers, which of them are new to the index, and hashes."""
        sizes = ends - starts
        chunks = span_chunks(data, starts, sizes)
        hashes = chunk_hashes(*chunks, sizes)
        return *self._add(hashes, sizes, *chunks), hashes

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, first: np.ndarray, rest: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum(more) - more

        def same(found: np.ndarray, row: np.ndarray) -> np.ndarray:
            """Whether the strings ``found`` in the index have the bytes of the rows."""
            equal = (self.sizes.values[found] == sizes[row]) & (self.first.values[found] == first[row])
            long = np.flatnonzero(equal & (more[row] > 0))
            count = more[row[long]]
            differ = self.rest.values[ragged(self.at.values[found[long]], count)] != rest[ragged(begin[row[long]], count)]
            equal[np.repeat(long, count)[differ]] = False
            return equal

        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        numbers, open_ = self.table[slot].astype(np.int64), np.arange(len(hashes))
        guessed = numbers >= 0
        guessed[guessed] = same(numbers[guessed], open_[guessed])
        open_ = open_[~guessed]
        missed, keys, fresh = open_, hashes.copy(), [np.zeros(0, np.int64)]
        while len(open_):
            found, new = self._numbers(keys[open_])
            new = open_[new]
            fresh.append(new)
            self.sizes.append(sizes[new])
            self.first.append(first[new])
            self.at.append(len(self.rest) + np.cumsum(more[new]) - more[new])
            self.rest.append(rest[ragged(begin[new], more[new])])
            good = same(found, open_)
            numbers[open_[good]] = found[good]
            open_ = open_[~good]
            keys[open_] = mix(keys[open_] + np.uint64(1))
        self.table[slot[missed]] = numbers[missed]
        return numbers, np.concatenate(fresh)

    def _numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number that each key has, and where (in ``keys``) those that were new first stand."""
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        number = np.full(len(distinct), -1)
        for held, numbers in (self.known, self.lately):
            if len(held):
                pos = np.minimum(np.searchsorted(held, distinct), len(held) - 1)
                number = np.where(held[pos] == distinct, numbers[pos], number)
        fresh = np.flatnonzero(number < 0)
        fresh = fresh[np.argsort(at[fresh])]
        number[fresh] = len(self) + np.arange(len(fresh))
        self.lately = _merged(self.lately, distinct[fresh], number[fresh])
        if 8 * len(self.lately[0]) > max(len(self.known[0]), 1 << 16):
            self.known, self.lately = _merged(self.known, *self.lately), (self.lately[0][:0], self.lately[1][:0])
        return number[inverse], at[fresh]


def _merged(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = np.concatenate((held[0], keys)), np.concatenate((held[1], numbers))
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 bytes of nonnegative values below 2**35, and each value's byte count."""
    size = 1 + sum((values >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[end[has] - size[has] + k] = ((values[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out, size = np.zeros(len(last), np.int64), last - first + 1
    for k in range(5):
        has = size > k
        out[has] |= (data[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def cells(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column's rows, one after another, and the rows' offsets."""
    data, offsets = text_buffer(column)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
