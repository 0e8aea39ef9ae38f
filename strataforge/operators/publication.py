"""Publications that can be resumed: what earlier attempts have left, and a staged write with read-back and a completion marker."""

from __future__ import annotations

from collections.abc import Callable
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import fullmatch, short_digest
from strataforge.operators.contracts import OBJECT_ID, receipt_errors
from strataforge.store import filesystem

# States and codes of the format.
STATES = ["already_published", "publication_recovered", "already_published_partial", "prior_execution_unknown", "first_run"]
PRODUCER = r"[1-9][0-9]*-[1-9][0-9]*"


def recovery_branch(bundle_id: Column, run: Column, attempt: Column) -> Column:
    """The name under which an attempt's result is kept until it is published."""
    return F.concat_ws("-", F.lit("refs/heads/recovery-actions"), run, attempt, short_digest(F.concat(bundle_id, F.lit(":result"))))


def publication_states(bundles: DataFrame, completed: DataFrame, refs: DataFrame, attempts: DataFrame, current: str | None = None) -> DataFrame:
    """(bundle_id, state, error, producer, status, producers): what is known of each bundle (bundle_id, bundle_blob).

    ``completed`` holds completion markers (bundle_id, bundle_blob, status, source_ref); ``refs`` the branches of recovered
    results (bundle_id, ref, type, sha, status), those with another name being none; ``attempts`` what each producer saved
    (bundle_id, producer, admission_state, and receipt or null: a struct of schema, bundle_id, bundle_blob, source_ref, status,
    collection_errors, run_id, run_attempt, files). A marker for other content is an error. Otherwise the first of these counts:
    a marker, branches (their last producer's result), receipts (the newest producer's), admissions without a receipt other than
    ``current``'s. ``producers`` is how many stand behind the state.
    """
    c = F.col
    mark = completed.select("bundle_id", F.struct(c("bundle_blob").alias("blob"), "status", "source_ref").alias("_mark"))
    number = lambda k: F.regexp_extract("ref", rf"\Arefs/heads/recovery-actions-([1-9][0-9]*)-([1-9][0-9]*)-[0-9a-f]{{12}}\z", k)
    named = refs.withColumns({"_run": number(1), "_attempt": number(2)}).where((c("_run") != "") & (c("ref") == recovery_branch(c("bundle_id"), c("_run"), c("_attempt"))))
    place = F.struct(F.length("_run").alias("a"), c("_run").alias("b"), F.length("_attempt").alias("c"), c("_attempt").alias("d"), F.concat_ws("-", "_run", "_attempt").alias("producer"), "status")
    sound = F.coalesce((c("type") == "commit") & fullmatch(c("sha"), OBJECT_ID), F.lit(False))
    recovered = named.groupBy("bundle_id").agg(F.count("*").alias("_refs"), F.max(place).alias("_ref"), F.max((~sound).cast("int")).alias("_bad_ref"))
    known = attempts.where(fullmatch(c("producer"), PRODUCER)).join(bundles.select("bundle_id", c("bundle_blob").alias("_blob")), "bundle_id")
    with_receipt = known.where("receipt is not null").select(c("bundle_id").alias("_bundle"), "producer", c("_blob").alias("wanted_blob"), c("bundle_id").alias("wanted_id"), "receipt.*")
    run, attempt = (F.split("producer", "-")[k] for k in (0, 1))
    newest = F.struct(F.length(run).alias("a"), run.alias("b"), F.length(attempt).alias("c"), attempt.alias("d"), "producer", "status")
    saved = receipt_errors(with_receipt).withColumn("_newest", newest)
    receipts = saved.groupBy("_bundle").agg(F.count("*").alias("_saved"), F.max("_newest").alias("_receipt"), F.max(F.when(c("error").isNotNull(), F.struct("_newest", "error"))).getField("error").alias("_bad_receipt")).withColumnRenamed("_bundle", "bundle_id")
    open_ = c("receipt").isNull() & (c("admission_state") == "source_ready") & (c("producer") != F.lit(current or ""))
    unknown = known.where(open_).groupBy("bundle_id").agg(F.count("*").alias("_unknown"))
    out = bundles.select("bundle_id", "bundle_blob")
    for more in (mark, recovered, receipts, unknown):
        out = out.join(more, "bundle_id", "left")
    changed = ~F.coalesce((c("_mark.blob") == c("bundle_blob")) & (c("_mark.status") == "materialized") & fullmatch(c("_mark.source_ref"), OBJECT_ID), F.lit(False))
    found = [c("_mark").isNotNull(), c("_refs").isNotNull(), c("_saved").isNotNull(), c("_unknown").isNotNull()]
    pick = lambda *values: F.when(found[0], values[0]).when(found[1], values[1]).when(found[2], values[2]).when(found[3], values[3])
    none = F.lit(None).cast("string")
    error = pick(F.when(changed, "completed_bundle_identity_changed"), F.when(c("_bad_ref") == 1, "invalid_recovery_commit"), c("_bad_receipt"), none)
    out = out.withColumns({"error": error, "_state": pick(*map(F.lit, STATES[:4]))})
    return out.select(
        "bundle_id", F.when(c("error").isNull(), F.coalesce("_state", F.lit(STATES[4]))).alias("state"), "error", F.when(c("error").isNull(), pick(none, c("_ref.producer"), c("_receipt.producer"), none)).alias("producer"),
        F.when(c("error").isNull(), pick(c("_mark.status"), c("_ref.status"), c("_receipt.status"), none)).alias("status"), F.coalesce(pick(F.lit(1), c("_refs"), c("_saved"), c("_unknown")), F.lit(0)).cast("long").alias("producers"),
    )


def _digest_columns(columns: list[str]) -> list[Column]:
    """Count and two sums of row hashes: the same for the same rows in any order."""
    every = [F.col(f"`{x}`") for x in columns]
    return [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(F.xxhash64(F.lit(seed), *every).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"h{seed}") for seed in (1, 2))]


def table_digest(rows: DataFrame) -> str:
    """An identity of a table's rows, whatever their order (map columns have none)."""
    return "-".join(str(x) for x in rows.agg(*_digest_columns(rows.columns)).first())


def _read(spark: SparkSession, path: str) -> dict | None:
    system, file = filesystem(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small file that must not exist."""
    system, file = filesystem(spark, path)
    stream = system.create(file, False)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()


def _attempts(spark: SparkSession, path: str) -> list[str]:
    """Attempts below ``path``, newest (largest number) first."""
    system, folder = filesystem(spark, f"{path}/attempts")
    return sorted((s.getPath().getName() for s in system.listStatus(folder)), key=int, reverse=True) if system.exists(folder) else []


def published(spark: SparkSession, path: str, identity: str) -> DataFrame | None:
    """The published rows at ``path``, or None while there are none; other content than ``identity`` is an error."""
    mark = _read(spark, f"{path}/completed.json")
    if mark is None:
        return None
    if mark["identity"] != identity:
        raise ValueError("completed_bundle_identity_changed")
    return spark.read.parquet(f"{path}/attempts/{mark['attempt']}/data")


def publish(rows: DataFrame, path: str, identity: str, *, again: bool = False, after: Callable[[str], None] = lambda step: None) -> str:
    """Publish ``rows`` below ``path`` once, under the identity of what they are made from; returns the state found or reached.

    An attempt notes its admission, writes its rows, reads them back (their digest must be the one observed while they were
    written), notes a receipt, and completes with a marker that can only be created. Whatever breaks off, a later call finds the
    marker (``already_published``), or a receipt whose rows still have its digest and completes it without computing anything
    (``publication_recovered``), or an attempt of unknown outcome: it stops there (``prior_execution_unknown``) unless ``again``
    allows another attempt (``published``, as after ``first_run``). ``after`` is called with each step's name.
    """
    spark = rows.sparkSession
    if published(spark, path, identity) is not None:
        return STATES[0]
    earlier = _attempts(spark, path)
    for attempt in earlier:
        receipt = _read(spark, f"{path}/attempts/{attempt}/receipt.json")
        if receipt and receipt["identity"] == identity and table_digest(spark.read.parquet(f"{path}/attempts/{attempt}/data")) == receipt["digest"]:
            _put(spark, f"{path}/completed.json", {"identity": identity, "attempt": attempt, "digest": receipt["digest"]})
            return STATES[1]
    if earlier and not again:
        return STATES[3]
    attempt = str(int(earlier[0]) + 1 if earlier else 1)
    here = f"{path}/attempts/{attempt}"
    _put(spark, f"{here}/admission.json", {"identity": identity, "state": "source_ready"})  # two runs can't take one number
    after("admission")
    seen = Observation()
    rows.observe(seen, *_digest_columns(rows.columns)).write.parquet(f"{here}/data")
    after("data")
    digest = "-".join(str(seen.get[k]) for k in ("rows", "h1", "h2"))
    if table_digest(spark.read.parquet(f"{here}/data")) != digest:
        raise ValueError("recovered_readback_mismatch")
    _put(spark, f"{here}/receipt.json", {"identity": identity, "digest": digest})
    after("receipt")
    _put(spark, f"{path}/completed.json", {"identity": identity, "attempt": attempt, "digest": digest})
    return "published"
