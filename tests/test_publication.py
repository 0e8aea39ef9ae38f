"""Publications that break off at any step, and the states of many bundles."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strataforge.operators.publication import publication_states, publish, published, table_digest


class Stop(Exception):
    pass


def stop_after(step):
    def after(name):
        if name == step:
            raise Stop

    return after


@pytest.fixture
def rows(spark):
    return spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("v")).repartition(3)


def failing(spark):
    return spark.range(5).select(F.raise_error(F.lit("computed again")).cast("long").alias("id"), F.lit("x").alias("v"))


def test_publish_once(spark, rows, tmp_path):
    path = f"{tmp_path}/p"
    assert published(spark, path, "i") is None and publish(rows, path, "i") == "published"
    assert publish(failing(spark), path, "i") == "already_published"
    assert table_digest(published(spark, path, "i")) == table_digest(rows) == table_digest(rows.orderBy("v"))
    for call in (lambda: publish(rows, path, "other"), lambda: published(spark, path, "other")):
        with pytest.raises(ValueError, match="completed_bundle_identity_changed"):
            call()


@pytest.mark.parametrize("step", ["admission", "data"])
def test_unknown_outcome(spark, rows, tmp_path, step):
    path = f"{tmp_path}/p"
    with pytest.raises(Stop):
        publish(rows, path, "i", after=stop_after(step))
    assert publish(failing(spark), path, "i") == "prior_execution_unknown" and published(spark, path, "i") is None
    assert publish(rows, path, "i", again=True) == "published" and published(spark, path, "i").count() == 100


def test_receipt_is_completed_without_computing(spark, rows, tmp_path):
    path = f"{tmp_path}/p"
    with pytest.raises(Stop):
        publish(rows, path, "i", after=stop_after("receipt"))
    assert published(spark, path, "i") is None
    assert publish(failing(spark), path, "i") == "publication_recovered"
    assert table_digest(published(spark, path, "i")) == table_digest(rows)


def test_a_failing_job_and_damaged_rows(spark, rows, tmp_path):
    path = f"{tmp_path}/p"
    with pytest.raises(Exception, match="computed again"):
        publish(failing(spark), path, "i")
    assert publish(rows, path, "i") == "prior_execution_unknown"
    with pytest.raises(Stop):
        publish(rows, path, "i", again=True, after=stop_after("receipt"))
    rows.limit(3).write.mode("append").parquet(f"{path}/attempts/2/data")  # no longer what the receipt says
    assert publish(failing(spark), path, "i") == "prior_execution_unknown"
    assert publish(rows.limit(0), path, "j", again=True) == "published" and published(spark, path, "j").count() == 0


RECEIPT = "struct<schema:string,bundle_id:string,bundle_blob:string,source_ref:string,status:string,collection_errors:int,run_id:string,run_attempt:string,files:map<string,string>>"


def test_states(spark):
    blob, ref = "b" * 40, "c" * 40
    branch = lambda b, r, a: f"refs/heads/recovery-actions-{r}-{a}-{hashlib.sha256(f'{b}:result'.encode()).hexdigest()[:12]}"
    receipt = lambda b, r, a, status="failed_or_partial": ("bundle-computation-receipt/2", b, blob, ref, status, 0, r, a, {"out.txt": "d" * 64})
    names = ["done", "changed", "partial", "branch", "badbranch", "saved", "badsaved", "unknown", "own", "fresh"]
    bundles = spark.createDataFrame([(n, blob) for n in names], "bundle_id string, bundle_blob string")
    completed = spark.createDataFrame([("done", blob, "materialized", ref), ("changed", "e" * 40, "materialized", ref), ("partial", blob, "failed_or_partial", ref)], "bundle_id string, bundle_blob string, status string, source_ref string")
    refs = spark.createDataFrame([("branch", branch("branch", 9, 1), "commit", ref, "s9"), ("branch", branch("branch", 10, 1), "commit", ref, "s10"), ("branch", branch("other", 99, 1), "commit", ref, "no"), ("branch", branch("branch", "05", 1), "commit", ref, "no"), ("badbranch", branch("badbranch", 1, 1), "tree", ref, "x"), ("done", branch("done", 1, 1), "tag", "x", "x")], "bundle_id string, ref string, type string, sha string, status string")
    attempts = spark.createDataFrame([("saved", "9-2", None, receipt("saved", "9", "2")), ("saved", "11-1", "source_ready", receipt("saved", "11", "1")), ("saved", "12-1", "source_ready", None), ("badsaved", "1-1", None, receipt("badsaved", "1", "2")), ("unknown", "1-1", "source_ready", None), ("unknown", "2-1", "source_ready", None), ("unknown", "3-1", "rejected", None), ("unknown", "x", "source_ready", None), ("own", "7-1", "source_ready", None)], f"bundle_id string, producer string, admission_state string, receipt {RECEIPT}")
    got = {r.bundle_id: tuple(r)[1:] for r in publication_states(bundles, completed, refs, attempts, current="7-1").collect()}
    changed = (None, "completed_bundle_identity_changed", None, None, 1)
    assert got == {
        "done": ("already_published", None, None, "materialized", 1), "changed": changed, "partial": changed, "branch": ("publication_recovered", None, "10-1", "s10", 2), "badbranch": (None, "invalid_recovery_commit", None, None, 1),
        "saved": ("already_published_partial", None, "11-1", "failed_or_partial", 2), "badsaved": (None, "producer_identity_mismatch", None, None, 1), "unknown": ("prior_execution_unknown", None, None, None, 2), "own": ("first_run", None, None, None, 0), "fresh": ("first_run", None, None, None, 0),
    }
