"""Values whose exact form counts: base64, canonical JSON, deletions, create-only batches, JSON arrays."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strataforge.functions import canonical_digest, canonical_json, decoded_base64, encoded_base64
from strataforge.operators.contracts import bundle_verdicts
from strataforge.operators.lifecycle import append_create_only, create_only
from strataforge.sources import write_json_array
from strataforge.streaming import create_only_stream


def lenient(text):
    try:
        return base64.b64decode(text)
    except ValueError:
        return None


def test_base64(spark):
    rnd = random.Random(5)
    texts = ["", "QQ", "QQ=", "QQ==", "QUI=QUI=", "QUI=", "Q=U=I=", "Q", "=", "====", "QUJD", "QU\nJD\n", "QQ==zz", "Q-U_J.D", "QUJDQ", "QQ=Q", "QQ=Q=", "é QUI=", "=QUJD=", "QUJD==="]
    texts += ["".join(rnd.choice("AbZ9+/==\n ") for _ in range(rnd.randrange(14))) for _ in range(400)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", decoded_base64(F.col("t")).alias("raw"))
    for r in rows.collect():
        assert (None if r.raw is None else bytes(r.raw)) == lenient(texts[r.k]), texts[r.k]
    raw = bytes(range(256)) * 3
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(encoded_base64(F.col("b")).alias("t")).first().t == base64.b64encode(raw).decode()


VALUES = [
    {"b": {"z": 1, "a": [1.0, 1e16, 1e-7, 0.1, -0.0, 123456789012345678901234567890]}, "a": "é\u007f\U0001f600\"\\/\n\u001f "}, [], {}, "x", None, True, 12, {"": {"é": 1, "z": 2, "\U0001f600": 3, "￿": 4}}, [[[{"k": [None, False]}]]],
]


def test_canonical_json(spark):
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0, indent=k % 3 or None) for k, v in enumerate(VALUES)] + ['{"a":1,"a":2}', "NaN", "[1e999]", "{", "", " 1 ", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", canonical_json(F.col("t")).alias("c"))
    got = {r.k: r.c for r in rows.collect()}
    for k, v in enumerate(VALUES):
        assert got[k] == json.dumps(v, sort_keys=True, separators=(",", ":"))
    assert [got[k] for k in range(len(VALUES), len(texts))] == ['{"a":2}', None, None, None, None, "1", None]
    entries = {"k": "é\n", "a": "\x01"}
    found = spark.createDataFrame([(entries,)], "m map<string,string>").select(canonical_digest(F.col("m")).alias("d")).first().d
    assert found == hashlib.sha256(json.dumps(entries, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize(
    ("deleted", "error"),
    [([1, 2], "invalid_delete_source_entry"), ([1, 1], "invalid_delete_files"), ([1, 1.0], "invalid_delete_files"), ([1, True], "invalid_delete_files"), ([1, "1"], "invalid_delete_source_entry"), ([None, None], "invalid_delete_files"), ([None], "invalid_delete_source_entry"),
     (["a.py", "a.py"], "invalid_delete_files"), (["a.py"], None), (["run_task.py"], "cannot_delete_run_task"), ("a.py", "invalid_delete_files"), ([], "successor_no_requested_changes")],
)
def test_deletions(spark, deleted, error):
    text = json.dumps({"schema": "private-task-bundle/4", "bundle_id": "bt-1", "base_source_ref": "a" * 40, "delete_files": deleted})
    got = bundle_verdicts(spark.createDataFrame([(text, "bt-1")], "raw string, bundle_id string")).first()
    assert (got.schema, got.error) == ("private-task-bundle/4", error)


def test_create_only_within_a_batch(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "k string, v string")
    held = table(("x", "1"), ("y", None))
    batch = table(("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", None), ("d", None), ("d", "1"), ("x", "1"), ("y", None), ("x2", "1"))
    got = sorted((r.k, r.outcome) for r in create_only(held, batch, "k", "v").collect())
    assert got == [("a", "conflict")] * 2 + [("b", "create")] * 2 + [("c", "create"), ("d", "conflict"), ("d", "conflict"), ("x", "same"), ("x2", "create"), ("y", "same")]
    with pytest.raises(ValueError, match="other content"):
        append_create_only(held, batch, "k", "v", f"{tmp_path}/t")
    append_create_only(held, batch.where("k in ('b', 'c', 'x')"), "k", "v", f"{tmp_path}/t")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("b", "1"), ("c", None)]


def test_stream_refuses_two_contents_of_a_key(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "k string, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: create_only_stream(spark.readStream.schema("k string, v string").parquet(f"{tmp_path}/in"), "k", "v", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    table(("a", "1"), ("a", "1"))
    run()
    assert [(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "1")]
    table(("b", "1"), ("b", "2"))
    with pytest.raises(Exception, match="other content"):
        run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def array(path):
    return json.loads("".join(open(f).read() for f in sorted(map(str, path.glob("part-*")))))


def test_json_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(None, "n"), (2, "b"), (None, "m"), (1, "a"), (1, "c")] * 30, "k int, v string")
    write_json_array(rows.repartition(5), f"{tmp_path}/a", "k")
    got = array(tmp_path / "a")
    assert [x.get("k") for x in got] == [None] * 60 + [1] * 60 + [2] * 30 and sorted(x["v"] for x in got) == sorted("nbmac" * 30)
    write_json_array(rows.limit(0), f"{tmp_path}/b", "k")
    assert array(tmp_path / "b") == []
    kinds = ["array<double>", "struct<x:double,y:array<float>>", "map<string,double>", "array<struct<x:map<int,double>>>"]
    for k, (kind, value) in enumerate(zip(kinds, [[1.0, float("nan")], (1.0, [float("inf")]), {"a": float("-inf")}, [({1: float("nan")},)]], strict=True)):
        with pytest.raises(Exception, match="finite"):
            write_json_array(spark.createDataFrame([(1, value)], f"k int, v {kind}"), f"{tmp_path}/c{k}", "k")
