"""Registered queries of files, huge logs and groups, live logs, publications and canonical values, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge import functions as fn
from strataforge.operators import medians, progress, publication, results
from strataforge.plans.deliveries import TIMEOUT_SQL, customer_logs
from strataforge.plans.registry import query, table
from strataforge.sources import read_lines
from strataforge.store import fresh_dir
from strataforge.streaming.logs import STATE_STORE, SUMMARY, live_summaries, newest


@query("""
WITH l AS (SELECT lang, doc_id, string_split(text, chr(10)) AS p FROM documents), u AS (SELECT lang, doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS k FROM l)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) AS line, octet_length(encode(raw)) AS n_bytes, sha256(raw) AS digest, true AS terminated FROM u""")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as text files, a folder per language, and read back by lines numbered through each folder."""
    path = fresh_dir(spark, "texts")
    texts = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    texts.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text").write.partitionBy("lang").text(path)
    lines = read_lines(spark, f"{path}/lang=*", per="folder")
    return lines.select(F.regexp_extract("file", "/lang=([^/]*)/", 1).alias("lang"), "line", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("digest"), "terminated")


@query("SELECT o_orderpriority, median(o_totalprice) AS median_price FROM orders GROUP BY o_orderpriority")
def large_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of five groups of all orders, selected by ranks: no group is sorted in one task."""
    return medians.medians(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "median_price", small=64)


@query("SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS value_before, lag(user_id) OVER (ORDER BY event_id) AS user_before FROM events")
def long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one log, each with the event before it."""
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("log"), "event_id", "value", "user_id")
    found = medians.with_row_before(rows, "log", "event_id", ["value", "user_id"], stretch=1 << 12)
    return found.select("event_id", "value", F.col("_before_value").alias("value_before"), F.col("_before_user_id").alias("user_before"))


@query(r"""
WITH c AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(text, '(?s).') AS p FROM documents),
     e AS (SELECT *, array_to_string(list_transform(p, lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
                  WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 65535 THEN format('\u{:04x}', unicode(c)) WHEN unicode(c) > 65535 THEN format('\u{:04x}\u{:04x}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) ELSE c END), '') AS t FROM c)
SELECT doc_id, sha256('{"a":[true,null,[' || n_chars || ']],"meta":{"lang":"' || lang || '","source":"' || source || '"},"text":"' || t || '"}') AS digest FROM e""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON with unsorted keys, and the digests of its canonical form."""
    text = F.to_json(F.struct("text", F.struct("source", "lang").alias("meta")))
    whole = F.concat(F.expr("left(t, length(t) - 1)"), F.lit(', "a" : [ true, null, ['), "n_chars", F.lit("] ] }"))
    return table(spark, sf_dir, "documents").withColumn("t", text).select("doc_id", fn.canonical_json_digest(whole).alias("digest"))


@query("""
WITH b AS (SELECT c_custkey, 'bt-' || c_custkey AS id, sha1(c_name) AS blob, c_acctbal, c_mktsegment FROM customer),
     m AS (SELECT c_custkey, c_acctbal > 9500 AND c_mktsegment <> 'BUILDING' AS ok FROM b WHERE c_acctbal > 9000),
     r AS (SELECT o_custkey AS c_custkey, count(*) AS n, arg_max(o_orderkey, o_orderkey) AS k, max((o_orderpriority = '5-LOW')::INT) AS bad FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 0 GROUP BY 1),
     s AS (SELECT o_custkey AS c_custkey, count(*) AS n, max(o_orderkey) AS k, max((o_orderpriority = '1-URGENT' AND o_totalprice > 250000)::INT) AS bad FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 0 GROUP BY 1),
     u AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 0 AND o_orderpriority <> '2-HIGH' GROUP BY 1),
     j AS (SELECT b.c_custkey, m.ok, m.c_custkey IS NOT NULL AS is_m, r.n AS rn, r.k AS rk, r.bad AS rb, s.n AS sn, s.k AS sk, s.bad AS sb, u.n AS un FROM b LEFT JOIN m USING (c_custkey) LEFT JOIN r USING (c_custkey) LEFT JOIN s USING (c_custkey) LEFT JOIN u USING (c_custkey)),
     e AS (SELECT *, CASE WHEN is_m THEN CASE WHEN NOT ok THEN 'completed_bundle_identity_changed' END WHEN rn > 0 THEN CASE WHEN rb = 1 THEN 'invalid_recovery_commit' END WHEN sn > 0 AND sb = 1 THEN 'result_identity_mismatch' END AS error FROM j)
SELECT c_custkey, CASE WHEN error IS NOT NULL THEN NULL WHEN is_m THEN 'already_published' WHEN rn > 0 THEN 'publication_recovered' WHEN sn > 0 THEN 'already_published_partial' WHEN un > 0 THEN 'prior_execution_unknown' ELSE 'first_run' END AS state, error,
       CASE WHEN error IS NULL AND NOT is_m THEN CASE WHEN rn > 0 THEN rk || '-1' WHEN sn > 0 THEN sk || '-1' END END AS producer, coalesce(CASE WHEN is_m THEN 1 WHEN rn > 0 THEN rn WHEN sn > 0 THEN sn ELSE un END, 0)::BIGINT AS producers FROM e""")
def publication_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bundles, rich ones with a completion marker; their orders as recovered branches, receipts and admissions."""
    c = F.col
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("bt-"), "c_custkey").alias("bundle_id"), F.sha1("c_name").alias("bundle_blob"), "c_acctbal", "c_mktsegment")
    held = F.when(c("c_mktsegment") == "BUILDING", F.sha1("c_mktsegment")).otherwise(c("bundle_blob"))
    completed = customers.where("c_acctbal > 9000").select("bundle_id", held.alias("bundle_blob"), F.when(c("c_acctbal") > 9500, "materialized").otherwise("failed_or_partial").alias("status"), F.sha1("bundle_id").alias("source_ref"))
    orders = table(spark, sf_dir, "orders").join(customers.select(c("c_custkey").alias("o_custkey"), "bundle_id", "bundle_blob"), "o_custkey").withColumn("run", c("o_orderkey").cast("string"))
    refs = orders.where("o_orderstatus = 'P'").select(
        "bundle_id", publication.recovery_branch(c("bundle_id"), c("run"), F.lit("1")).alias("ref"), F.when(c("o_orderpriority") == "5-LOW", "tag").otherwise("commit").alias("type"), F.sha1("run").alias("sha"), F.lit("materialized").alias("status")
    )
    blob = F.when((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 250000), F.sha1("run")).otherwise(c("bundle_blob"))
    receipt = F.struct(
        F.lit("bundle-computation-receipt/2").alias("schema"), "bundle_id", blob.alias("bundle_blob"), F.sha1("run").alias("source_ref"), F.lit("failed_or_partial").alias("status"), F.lit(0).alias("collection_errors"),
        c("run").alias("run_id"), F.lit("1").alias("run_attempt"), F.create_map(F.lit("result.jsonl"), F.sha2("run", 256)).alias("files"),
    )
    admission = F.when(c("o_orderpriority") == "2-HIGH", "rejected").otherwise("source_ready")
    attempts = orders.where("o_orderstatus in ('F', 'O')").select("bundle_id", F.concat(c("run"), F.lit("-1")).alias("producer"), admission.alias("admission_state"), F.when(c("o_orderstatus") == "F", receipt).alias("receipt"))
    states = publication.publication_states(customers.select("bundle_id", "bundle_blob"), completed, refs, attempts)
    return customers.select("c_custkey", "bundle_id").join(states, "bundle_id").select("c_custkey", "state", "error", "producer", "producers")


@query(TIMEOUT_SQL)
def live_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``timeout_from_logs`` again, from a stream that gets the events in four batches and is restarted for each."""
    runs, events = customer_logs(spark, sf_dir)
    folder, last = fresh_dir(spark, "live"), events.agg(F.max("line")).first()[0] or 0
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for quarter in range(4):
            events.where(F.expr(f"line * 4 div {last + 1}") == quarter).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")  # noqa: E731  a batch that is run again replaces its rows
            live_summaries(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = newest(spark.read.schema(SUMMARY).parquet(f"{folder}/out")).withColumn("file", F.col("file").cast("long"))
    listed = runs.select("file", F.col("size").alias("_size")).join(found, "file", "left")
    absent, bare = F.col("_size").isNull(), F.col("seen").isNull()
    status = F.when(absent, "missing").when(bare, "invalid").otherwise(F.col("status"))
    reason = F.when(absent, None).when(bare, F.when(F.col("_size") > 0, "no_valid_records").otherwise("empty")).otherwise(F.col("reason"))
    summary = listed.select("file", status.alias("status"), reason.alias("reason"), F.coalesce("records", F.lit(0)).alias("records"), "reported_elapsed_seconds", "median_item_seconds")
    return progress.timeout_pattern(summary.join(runs.drop("size"), "file")).select("file", "status", "reason", "records", "seconds_since_last_progress", "timeout_pattern")


@query("""
WITH c AS (SELECT conv_id, turn, hex(encode(text)) AS h, octet_length(encode(text)) AS n, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(octet_length(encode(text))) OVER (PARTITION BY conv_id) > 600 AS exceeded, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
     k AS (SELECT *, least(greatest(600 - before, 0), n)::BIGINT AS kept FROM c)
SELECT conv_id, turn, kept AS n_bytes, sha256(left(h, 2 * kept)) AS digest, exceeded FROM k WHERE kept > 0 OR turn = first""")
def limited_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of chunks of which 600 bytes are kept."""
    found = results.limited_output(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600)
    return found.select("conv_id", "turn", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.hex("text"), 256).alias("digest"), "exceeded")
