"""Every job-data query gives its SQL's rows on the smallest tables, and has rows."""

import pytest

from strataforge import plans
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, name):
    assert assert_same(spark, plans.QUERIES[name], plans.SQL[name], SMALL) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_manifest_rows_keep_repeated_and_null_names(spark):
    from strataforge.operators.identity import manifest_rows

    files = spark.createDataFrame([("h", "a", "x"), ("h", "a", "yy"), ("h", None, "zz"), (None, "b", "w")], "host string, name string, html string")
    got = {(r.host, r.name, r.n_files, r.total_bytes) for r in manifest_rows(files, "host", "name", "html").collect()}
    assert got == {("h", "a", 3, 5), ("h", None, 3, 5), (None, "b", 1, 1)} and manifest_rows(files, "host", "name", "html").select("digest").distinct().count() == 4


def test_manifest_map_with_a_repeated_page(spark, tmp_path):
    pages = [(1, "http://h/a", "x"), (1, "http://h/b", "yy"), (2, "http://i/c", "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert assert_same(spark, plans.QUERIES["manifest_map"], plans.SQL["manifest_map"], str(tmp_path)) == 3


@pytest.mark.parametrize("name", ["manifest_map", "set_checks"])
def test_no_list_of_a_whole_group(spark, name):
    assert "collect_list" not in plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
