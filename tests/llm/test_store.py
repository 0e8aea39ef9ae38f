"""Written tables, row identity, distributed positions."""

import os

from pyspark.sql import functions as F
import pytest

from strataforge.llm.store import RID, P, identified, is_scan, materialize, range_positions, shared_dir


def test_identity_survives_filters_and_tells_repeats_apart(spark, scanned, awkward):
    assert is_scan(scanned) and is_scan(scanned.where("doc_id > 3")) and not is_scan(awkward) and not is_scan(scanned.groupBy("doc_id").count())
    every = identified(scanned.select("doc_id", "_metadata"), "doc_id", scan=True)
    assert every.select(*RID).distinct().count() == scanned.count()
    some = identified(scanned.where("doc_id > 20").select("doc_id", "_metadata"), "doc_id", scan=True)
    assert some.exceptAll(every).count() == 0


def test_positions(spark):
    rows = spark.range(1000).select(F.floor(F.col("id") / 300).alias("hot"), F.xxhash64("id").alias("h"))
    placed = range_positions(rows, ["hot", "h"], "test").collect()
    ordered = sorted(placed, key=lambda r: r[f"{P}pos"])
    assert [r[f"{P}pos"] for r in ordered] == list(range(1000))
    assert [(r.hot, r.h) for r in ordered] == sorted((r.hot, r.h) for r in placed)


def test_tables_lie_in_the_shared_folder(spark):
    before = materialize(spark.range(3), "kind")
    assert all(f.startswith(shared_dir(spark).replace("file://", "file://")) for f in before.inputFiles())
    assert os.path.isdir(shared_dir(spark).removeprefix("file://"))


def test_release(spark, awkward):
    from strataforge.llm.blocks import blocked
    from strataforge.llm.store import TABLES, release

    path = materialize(spark.range(3)).inputFiles()[0].removeprefix("file://")
    blocked(awkward, "doc_id", "text", [])
    assert os.path.exists(path) and spark.catalog.listTables(pattern=f"{TABLES}*")
    release(spark)
    assert not os.path.exists(path) and not spark.catalog.listTables(pattern=f"{TABLES}*")


@pytest.mark.parametrize(("size", "rows"), [(1 << 26, 1), (0, 1), (0, 7), (0, 1 << 22)])
def test_rows_are_kept_where_they_are(spark, tmp_path, monkeypatch, size, rows):
    from strataforge.llm import store

    monkeypatch.setattr(store, "BITMAP_BYTES", size)
    monkeypatch.setattr(store, "BITMAP_ROWS", rows)
    table = spark.range(60).selectExpr("id", "cast(id as string) as `a.b`", "if(id % 7 = 0, null, id) as kept", "array(id) as list")
    table.repartition(3).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    known = store.identified(docs.select("id", "_metadata"), "id", scan=True)
    found = store.kept_rows(docs, known.where("id % 3 = 1 or id > 50").select(*store.RID))
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    got = sorted(found.collect())
    assert got == sorted(docs.where("id % 3 = 1 or id > 50").collect())
    assert store.kept_rows(docs, known.where("false").select(*store.RID)).count() == 0
    many = spark.range(100_000).select("id", F.lit("x").alias("text"))
    many.coalesce(1).write.parquet(f"{tmp_path}/many")
    docs = spark.read.parquet(f"{tmp_path}/many")
    chosen = store.identified(docs.select("id", "_metadata"), "id", scan=True).where("id % 1009 in (0, 7, 8) or id between 32766 and 32770")
    if rows != 1 or size:
        assert {r.id for r in store.kept_rows(docs, chosen.select(*store.RID)).collect()} == {k for k in range(100_000) if k % 1009 in (0, 7, 8) or 32766 <= k <= 32770}
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
