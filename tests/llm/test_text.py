"""Text kernels against regular expressions, and small packings."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from tokenizers import Regex, pre_tokenizers

from strataforge.llm import textcore as t
from strataforge.llm.packing import hilbert_keys
from strataforge.llm.pieces import PieceIndex, unvarint, varint

PIECES = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pieces(text):
    """The library's own pre-tokens, by their places in the text."""
    return [text[a:b] for _, (a, b) in PIECES.pre_tokenize_str(text)]


def cut(texts, what):
    out = []
    for i, j, data, offsets in t.slices(pa.array(texts, pa.string()), 64):
        raw = data.tobytes()
        if what == "words":
            starts, ends, first = t.words(data, offsets)
        else:
            starts, first = t.pretokens(data, offsets)
            ends = np.append(starts[1:], len(data))
        out += [[raw[a:b].decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])] for k in range(j - i)]
    return out


ALPHABET = "ab'sstrevmldLL  \n\t\r\x0b\x1c  !?.12é中½’\U0001f600"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40), st.text(max_size=20)), max_size=8))
def test_cuts(texts):
    assert cut(texts, "pretokens") == [pieces(x or "") for x in texts]
    assert cut(texts, "words") == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]


def test_classes_are_those_of_both_libraries():
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
        assert sorted(ord(x) for piece, _ in found for x in piece) == np.flatnonzero(t._classes() == kind).tolist()


def test_unassigned_and_new_code_points():
    texts = [":\U0003d000", "a\ua7cb's", "\ua7cb's x", "1\U0001e4f0 \U0003134f'll", "\x1c\x1d a\x85b\u2028c"]
    assert cut(texts, "pretokens") == [pieces(x) for x in texts]


def twins(size):
    """Two words of ``size`` letters that no hash by powers of an odd number modulo 2**64 tells apart."""
    bits = [bin(k).count("1") & 1 for k in range(size)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


def hashes(*spans):
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    end = np.cumsum([len(x.encode()) for x in spans])
    return t.span_hashes(data, np.append(0, end[:-1]), end)


def test_equal_spans_hash_equally():
    h = hashes("abc", " ", "abc", "abd", "abcdefgh", "abcdefgh\0", "abcdefghi", "xabc"[1:], "ab", "abcdefghi", "")
    assert h[0] == h[2] == h[7] and h[6] == h[9] and len(set(h.tolist())) == 8


def test_patterned_spans_and_windows():
    for size in (1024, 2048, 4096):
        assert len(set(hashes(*twins(size)).tolist())) == 2
    words = np.array([[5, 9][k] for k in [bin(k).count("1") & 1 for k in range(64)]], np.uint64)
    other = np.uint64(14) - words
    for size in (1, 2, 4, 5, 8, 13, 32, 50):
        rows = np.concatenate((words, other, words))
        h = t.window_hashes(rows, np.array([0, 64, 128]), size)
        assert h[0] == h[2] != h[1]
    rnd = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for size in (3, 7, 13):
        at = np.arange(400 - size + 1)
        classes = {}
        for h, k in zip(t.window_hashes(rnd, at, size).tolist(), at):
            classes.setdefault(tuple(rnd[k : k + size]), set()).add(h)
        assert all(len(x) == 1 for x in classes.values()) and len({min(x) for x in classes.values()}) == len(classes)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**34), max_size=50))
def test_varint(values):
    packed, sizes = varint(np.array(values, np.int64))
    assert unvarint(packed).tolist() == values and sizes.sum() == len(packed)


def spans(strings):
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    end = np.cumsum([len(x.encode()) for x in strings]).astype(np.int64)
    return data, np.append(0, end[:-1]), end


def test_piece_index():
    rnd, index, known = random.Random(3), PieceIndex(), {}
    for _ in range(6):
        strings = ["".join(rnd.choice("ab\0") for _ in range(rnd.choice([1, 2, 3, 8, 9, 17, 30]))) for _ in range(200)]
        numbers, fresh, _ = index.add(*spans(strings))
        for x, n in zip(strings, numbers.tolist()):
            assert known.setdefault(x, len(known)) == n
        assert len(index) == len(known) and len({strings[k] for k in fresh}) == len(fresh)


def test_piece_index_tells_strings_of_one_hash_apart():
    index, known = PieceIndex(), {}
    for turn in range(3):
        strings = [f"{k % 7}-{'long' * (k % 3)}-{turn * (k % 2)}" for k in range(60)]
        data, start, end = spans(strings)
        numbers, _ = index._add(np.zeros(60, np.uint64), end - start, *t.span_chunks(data, start, end - start))
        for x, n in zip(strings, numbers.tolist()):
            assert known.setdefault(x, n) == n
        assert len(set(known.values())) == len(known)


def test_hilbert_curve_is_one_unbroken_path():
    points = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    keys = hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[:, np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_windows_of_equal_hashes_stay_apart():
    """Two blocks send windows under one 64-bit hash: only those whose second hashes agree are repeats."""
    import pyarrow as pa

    from strataforge.llm import blocks as b

    def sent(block, ids, checks):
        keys, number, least, _ = b.distinct(np.full(len(ids), 7, np.uint64), np.array(ids), np.array(checks, np.uint64))
        entries = np.zeros(len(keys), b.CHECKED)
        entries["id"], entries["check"][number] = least, checks
        return number, keys, b.entry_rows(block, keys, entries, 4)

    one, keys, first = sent(1, [5, 5, 9], [100, 200, 200])
    two, more, second = sent(2, [3, 6, 8], [300, 200, 100])
    assert len(keys) == 2 and len(more) == 3
    told = b._report(8, b.CHECKED, b.not_first_checked)(pa.concat_tables([first, second]))
    by = {block: told.filter(pa.compute.equal(told[b.BLOCK], block)) for block in (1, 2)}
    assert b.told(by[1], keys, 4)[one].tolist() == [0, 0, 0]
    assert b.told(by[2], more, 4)[two].tolist() == [0, 1, 1]


def test_second_hashes_are_others():
    data = np.frombuffer(b"alpha beta gamma delta epsilon-zeta-eta", np.uint8)
    starts, ends, _ = t.words(data, np.array([0, len(data)]))
    assert not set(t.span_hashes(data, starts, ends)) & set(t.span_hashes(data, starts, ends, 99))
    from strataforge.llm.jaccard import set_digests

    found = np.arange(1, 7, dtype=np.uint64)
    one, two, three, none = set_digests(found[[0, 1, 2, 1, 0, 2, 3, 4, 5]], np.array([3, 3, 3, 0])).to_pylist()
    assert one == two != three and none is None and one[:8] != one[8:]
