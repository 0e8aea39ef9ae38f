"""Medians and rows before, cut into many parts, against plain ones."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strataforge.operators import medians as m
from strataforge.operators.progress import method_medians, monotony_errors


@pytest.mark.parametrize("small", [0, 50, 1 << 20])
def test_medians(spark, small):
    rnd = random.Random(small)
    groups = {"even": [rnd.random() for _ in range(400)], "odd": [rnd.gauss(0, 9) for _ in range(401)], "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 300, "halves": [1.0] * 150 + [2.0] * 150, None: [rnd.choice([0.5, -1.5, 8.0]) for _ in range(99)], "large": [1e308, 1e308]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("odd", None), ("even", None)]
    rnd.shuffle(rows)
    got = {r.k: r.median for r in m.medians(spark.createDataFrame(rows, "k string, v double").repartition(7), "k", "v", small=small).collect()}
    want = {k: statistics.median(vs) for k, vs in groups.items()}
    want["large"] = 1e308  # two equal values have themselves as their mean
    assert got == pytest.approx(want)


def test_large_groups_are_not_sorted_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(m, "SMALL", 10)
    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 2000).cast("double").alias("v"))
    found = m.medians(rows, "k", "v", small=10)
    assert "median(" not in found._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
    assert {r.k: r.median for r in found.collect()} == {k: statistics.median([x * 7919 % 2000 for x in range(2000) if x % 2 == k]) for k in (0, 1)}
    assert {(r.method, r.trials, r.median_seconds) for r in method_medians(spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0), ("b", None)], "method string, seconds double")).collect()} == {("a", 2, 1.5), (None, 1, 4.0), ("b", 1, None)}


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_row_before(spark, stretch):
    rnd = random.Random(stretch)
    rows = [(f, n, rnd.randrange(50) if rnd.random() < 0.9 else None, rnd.random()) for f in ("a", "b") for n in sorted(rnd.sample(range(-300, 900), 250))]
    got = {(r.f, r.n): (r._before_p, r._before_e) for r in m.with_row_before(spark.createDataFrame(rows, "f string, n long, p long, e double").repartition(5), "f", "n", ["p", "e"], stretch=stretch).collect()}
    want = {(b[0], b[1]): (a[2], a[3]) if a[0] == b[0] else (None, None) for a, b in zip([("", 0, 0, 0), *rows], rows, strict=False)}
    assert got == want


def test_one_huge_log(spark, monkeypatch):
    monkeypatch.setattr(m, "STRETCH", 64)
    rows = spark.range(1, 5001).select(F.lit("log").alias("file"), F.col("id").alias("line"), F.when(F.col("id") == 3000, 1).otherwise(F.col("id")).alias("processed"), F.col("id").cast("double").alias("elapsed_seconds"), F.lit(None).cast("string").alias("error"))
    assert [r.line for r in monotony_errors(rows.repartition(6)).where("error is not null").collect()] == [3000]
