"""Vector codes against a comparison with every entry."""

from collections import defaultdict
import math
import random

import numpy as np
import pytest

from strataforge.llm import vector_codes as v
from strataforge.llm.vector_codes import PARTS, Balls, books_digest, cuts, decoded, vector_codes

KIND = "vec_id long, embedding array<double>, label string, code string, error string"


def plain(rows, entries=v.ENTRIES, rounds=v.ROUNDS):
    """(code, error) of rows (vec_id, whole components), and the codebooks, in whole numbers."""
    at = cuts(len(rows[0][1]))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][at[k] : at[k + 1]] for r in order] for k in range(PARTS)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(books[k], x[at[k] : at[k + 1]]) for k in range(PARTS)] for _, x in rows]
        if turn == rounds:
            return [(bytes(j for _, j in f).hex(), sum(d for d, _ in f)) for f in found], books
        for k in range(PARTS):
            held = defaultdict(list)
            for f, (_, x) in zip(found, rows, strict=True):
                held[f[k][1]].append(x[at[k] : at[k + 1]])
            for j, xs in held.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]


def check(spark, rows, monkeypatch, entries):
    monkeypatch.setattr(v, "ENTRIES", entries)
    usable = [(i, x, label) for i, x, label in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    length = len(min(usable, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[1])
    usable = [(i, [math.floor(c * 1024) for c in x], label) for i, x, label in usable if len(x) == length]
    codes, books = plain([r[:2] for r in usable], entries)
    total = defaultdict(int)
    for (_, _, label), (_, e) in zip(usable, codes, strict=True):
        total[label] += e
    got, found = vector_codes(spark.createDataFrame([(*r, "x", "y") for r in rows], KIND))
    got = got.collect()
    assert books_digest(found) == books_digest([np.array(b) for b in books])
    want = [(i, label, c, e, total[label]) for (i, _, label), (c, e) in zip(usable, codes, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.label, r.code.hex(), r.error, r.label_error)) for r in got)
    return found


@pytest.mark.parametrize("length", [16, 6, 3])
def test_codes(spark, monkeypatch, length):
    rnd = random.Random(length)
    centres = [[rnd.gauss(0, 1) for _ in range(length)] for _ in range(9)]
    rows = [(k, [c + rnd.gauss(0, 0.1) for c in centres[k % 9]], f"l{k % 3}" if k % 4 else None) for k in range(160)]
    rows += [(3, rows[3][1], "l1"), (3, rows[3][1], "l1"), (None, rows[5][1], "l2"), (None, rows[6][1], "l2"), (900, None, "l1"), (901, [], "l1"), (902, [float("nan")] * length, "l1"), (903, [float("inf")] + [0.0] * (length - 1), None), (904, [None] * length, None), (905, [1.0] * (length + 1), "l1"), (906, [0.0] * length, "")]
    books = check(spark, rows, monkeypatch, 12)
    table = spark.createDataFrame([(bytearray([1, 0, 11, 2]),)], "code binary")
    assert decoded(table, books).first().whole == [c for k, j in enumerate((1, 0, 11, 2)) for c in books[k][j].tolist()]


def test_ties_copies_and_few_rows(spark, monkeypatch):
    check(spark, [(k, [float(k % 2), 0.0, 0.0, 0.0], "a") for k in range(8)], monkeypatch, 6)  # equal entries: the first one wins
    check(spark, [(1, [0.25, -0.0001, 3.0, 4.0], None)], monkeypatch, 6)
    check(spark, [(k, [900.5 * k, -1e4 * k, 0.5, 7.0], "a") for k in range(20)], monkeypatch, 5)  # whole numbers beyond doubles' squares


def test_no_rows(spark):
    for rows in ([], [(1, None, "a", "x", "y"), (2, [float("nan")], None, "x", "y")]):
        got, books = vector_codes(spark.createDataFrame(rows, KIND))
        assert got.count() == 0 and all(len(b) == 0 for b in books)


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_balls_equal_a_comparison_with_all(kind):
    rng = np.random.default_rng(4)
    entries = rng.integers(-50, 50, (64, 4))
    entries[10] = entries[3]
    parts = np.concatenate((entries[rng.integers(0, 64, 4000)] + rng.integers(-6, 7, (4000, 4)), rng.integers(-900, 900, (500, 4))))
    squares = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    ball = Balls(entries, kind)
    for now in (squares.argmin(axis=1), np.zeros(len(parts), int), rng.integers(0, 64, len(parts))):
        ball.compared = 0
        code, error = ball.nearest(parts, now)
        assert (code == squares.argmin(axis=1)).all() and (error == squares.min(axis=1)).all()
    ball.compared = 0
    ball.nearest(parts[:4000], squares[:4000].argmin(axis=1))
    assert ball.compared < 4000 * 64 // 4  # near entries, stable cores and narrow rings are most of it
