"""The registered queries on the smallest tables: SQL where there is any, else definitions."""

from collections import defaultdict

import pytest

import corpus_pipeline
from strataforge.llm import queries
from strataforge.llm.jaccard import jaccard_components
from tests.llm import brute
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert assert_same(spark, queries.QUERIES[name], queries.SQL[name], SMALL) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"op11_spelling"}))
def test_query_returns_every_row(spark, name):
    table, column = ("embeddings", "vec_id") if "embeddings" in name else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(column).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, SMALL).select(column).collect()} == want


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == columns
            kept[name] = ([(r.doc_id, r.text) for r in before.collect()], {r.doc_id: r.text for r in now.collect()})
        else:
            assert {r.doc_id for r in now.select("doc_id").collect()} == {r.doc_id for r in before.collect()}
        before = now
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows, good = kept["quality classifier"]
    known = [(i, labels[i]) for i, _ in rows if i in labels]
    assert sum((i in good) == q for i, q in known) >= 0.9 * len(known)
    rows, stay = kept["exact dedup"]
    top = {}
    for i, text in rows:
        top[text] = max(top.get(text, i), i)
    assert stay == {i: t for t, i in top.items()}
    rows, stay = kept["n-gram Jaccard join"]
    first = {i for i, n, c in brute.jaccard(rows, 5, 80) if n == 0 or i == c}
    assert set(stay) == first
    rows, stay = kept["substring dedup"]
    assert stay == {i: w if n else dict(rows)[i] for i, _, n, w in brute.windows_removed(rows, 13)}


def test_stages_take_tables_that_are_no_files(spark):
    rows = [(1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.exact_stage(spark, docs, SMALL).collect()} == {2, None}
    assert corpus_pipeline.near_stage(spark, docs, SMALL).count() == 2
    assert corpus_pipeline.substring_stage(spark, docs, SMALL).count() == 3
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0


def test_groups_of_near_classes_share_one_class(spark):
    rows = [(k, " ".join(f"w{j}" if j != k else "x" for j in range(60))) for k in range(40)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.component_id].add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, _, c in brute.jaccard(rows, 4, 85) if c == top) for top in {c for _, _, c in brute.jaccard(rows, 4, 85)})


def test_stages_take_columns_of_any_name_and_null_rows(spark):
    good, bad = "one two three four five six seven. " * 4, "!!%% ## @@ $$ 11 " * 6
    rows = [(k, (good if k % 2 else bad) + f"w{k}", "en", "s", 5, "x", "y") for k in range(40)] + [(None, None, None, None, None, None, None), (3, good + "w3", "en", "s", 5, "x", "y"), (None, good, "en", "s", 5, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `kept` string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        got = [r.doc_id for r in out.collect()]
        assert name == "quality classifier" or None in got
    packed = corpus_pipeline.packing_stage(spark, docs, SMALL)
    assert packed.where("start = 0").count() == len(rows)


def test_pipeline_drops_what_its_stages_wrote(spark):
    from strataforge.llm.store import TABLES, mark

    before, tables = mark(), len(spark.catalog.listTables(pattern=f"{TABLES}*"))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert mark() - before < 8 and len(spark.catalog.listTables(pattern=f"{TABLES}*")) == tables
