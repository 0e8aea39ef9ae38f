"""Spelling variants against plain counts and plain edits."""

from collections import Counter
import random
import re
import zlib

import numpy as np
import pytest

from strataforge.llm import spelling as s
from strataforge.llm.spelling import LETTERS, Filters, checksums, edit_hashes, op11_spelling, spelling_variants, word_hashes
from tests.llm.brute import LOWER
from tests.llm.conftest import awkward_texts


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (len(a) == len(b) and a[k + 1 :] == b[k + 1 :] or len(a) + 1 == len(b) and a[k:] == b[k + 1 :])


def plain(rows):
    """{word: (form, root, n, n_near, form_n)} of rows (doc_id, text)."""
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    letters, forms = sorted({c for w in count for c in w}), {}
    for w, n in count.items():
        if len(w) > 200:
            around = {x for x in count if one_edit(w, x)}
        else:
            around = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near = [x for x in around if x in count and x != w]
        form = min(near, key=lambda x: (-count[x], x), default=None)
        forms[w] = (form if form and count[form] >= 10 * n else None, len(near))
    out = {}
    for w, n in count.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[w] = (forms[w][0], root, n, forms[w][1], count[forms[w][0]] if forms[w][0] else None)
    return out


def variants(seed, documents=120):
    """Documents of a few words at very different counts, with edits of edits."""
    rnd, letters = random.Random(seed), "abcdefgé×ÿ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(7, 12))) for _ in range(25)]
    pool = []
    for k, w in enumerate(words):
        pool += [w] * (400 if k % 3 else 3)
        for _ in range(6):
            at, x = rnd.randrange(len(w)), w
            x = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
            pool += [x] * rnd.choice([1, 2, 5, 30])
            at = rnd.randrange(len(x))
            pool += [x[:at] + rnd.choice(letters) + x[at + 1 :]] * 2
    rnd.shuffle(pool)
    step = len(pool) // documents + 1
    return [(k, rnd.choice([" ", ", ", "\n", "1"]).join(pool[k * step : (k + 1) * step])) for k in range(documents)]


def found(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = variants(seed)
    want = plain(rows)
    assert any(f and r != f for f, r, *_ in want.values())  # a form of a form
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_shards_and_turns_change_nothing(spark, monkeypatch):
    rows = variants(3)
    monkeypatch.setattr(s, "SHARD_WORDS", 20)
    monkeypatch.setattr(s, "FILTER_BYTES", 100)
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


LONG = [(None, "Äpfelbaum äpfelbaum ÄPFELBAUM Äpfelbaum"), (None, None), (1, ""), (2, "aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa AAAAAAAA"), (3, "x" * 5000 + " " + "x" * 5000), (4, "y" + "x" * 4999 + "Ā" + "x" * 5000), (4, "y" + "x" * 4999), (5, "dont't ×÷×÷×÷× ×÷×÷×÷×"), (5, "dont't ×÷×÷×÷× ×÷×÷×÷×")]


@pytest.mark.parametrize("kind", ["awkward", "scanned"])
def test_awkward_rows(spark, request, kind):
    assert found(spelling_variants(request.getfixturevalue(kind))) == plain(awkward_texts())
    if kind == "awkward":
        assert found(spelling_variants(spark.createDataFrame(LONG, "doc_id long, text string"))) == plain(LONG)


def test_no_rows(empty, spark):
    assert spelling_variants(empty).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "only once seen")], "doc_id long, text string")).count() == 0


def test_query_on_a_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(op11_spelling(spark, folder)) == plain(rows)


def test_checksums_go_on():
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    starts = rnd.integers(0, 4000, 300)
    sizes = rnd.integers(0, 900, 300)
    sizes[::2] %= 20
    seeds = rnd.integers(0, 1 << 32, 300).astype(np.uint32)
    got = checksums(data, starts, sizes, seeds)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes(), int(c)) for a, n, c in zip(starts, sizes, seeds, strict=True)]


def test_edit_hashes_are_hashes_of_the_edits():
    import pyarrow as pa

    words = ["aabbccd", "abcdefg", "ggggggg"]
    matrix = np.array([list(w.encode()) for w in words], np.uint8)
    for size, letter, row, place, hashes in edit_hashes(matrix, list(b"abcdefgh")):
        spelled = [words[r][:k] + (chr(letter) if letter else "") + words[r][k + 1 :] for r, k in zip(row, place, strict=True)]
        assert len(set(zip(row, spelled, strict=True))) == len(spelled)
        assert (word_hashes(pa.array(spelled, pa.string()))[0] == hashes).all() and all(len(x) == size for x in spelled)


def test_filters_hold_all_and_little_else():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2)
    members = hashes[:30_000]
    shard = Filters.shard(members, 3)
    filters = Filters({LETTERS: 3}, {(LETTERS, k): Filters.build(members[shard == k]) for k in range(3)})
    assert set(range(30_000)) <= set(filters.positive(members, LETTERS).tolist())
    assert len(filters.positive(hashes[30_000:], LETTERS)) < 600 and not len(filters.positive(members, LETTERS + 1))
