"""Registered queries of logs, bundles, receipts, deliveries and stored files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge import functions as fn
from strataforge.operators import contracts, identity, lifecycle, progress, results, snapshots
from strataforge.plans.registry import query, table
from strataforge.sources import lines_of, lock_verdicts, paged


def _pick(number: Column, *values: Column | str | None) -> Column:
    """The value at ``number`` modulo their count."""
    out = None
    for k, value in enumerate(values):
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(number % len(values) == k, value) if out is None else out.when(number % len(values) == k, value)
    return out


TIMEOUT_SQL = """
WITH f AS (SELECT c_custkey AS file, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey = 3 THEN 0 ELSE 1 END AS size, c_nationkey % 2 = 0 AS timed_out, CASE WHEN c_nationkey % 5 > 0 THEN abs(c_acctbal) END AS wall, CASE WHEN c_nationkey % 3 = 0 THEN 100.0 + c_nationkey END AS budget FROM customer),
     e AS (SELECT f.file, event_id AS line, value, CASE WHEN value < 1 THEN 'invalid_item_seconds' END AS error FROM events JOIN f ON user_id = f.file WHERE size > 0),
     b AS (SELECT file, min(line) FILTER (error IS NOT NULL) AS bad, count(*) AS n FROM e GROUP BY file),
     a AS (SELECT e.file, count(*) AS records, median(value) AS med, max(line)::DOUBLE AS last FROM e JOIN b USING (file) WHERE bad IS NULL OR line < bad GROUP BY e.file),
     s AS (SELECT f.*, CASE WHEN size IS NULL THEN 'missing' WHEN b.bad IS NOT NULL OR b.n IS NULL THEN 'invalid' ELSE 'valid' END AS status,
                  CASE WHEN size IS NULL THEN NULL WHEN size = 0 THEN 'empty' WHEN b.n IS NULL THEN 'no_valid_records' WHEN b.bad IS NOT NULL THEN 'invalid_item_seconds' END AS reason, coalesce(records, 0) AS records, med, last FROM f LEFT JOIN b USING (file) LEFT JOIN a USING (file)),
     g AS (SELECT *, CASE WHEN status = 'valid' AND wall IS NOT NULL THEN greatest(0.0, wall - last) END AS gap FROM s),
     t AS (SELECT *, CASE WHEN gap IS NOT NULL AND timed_out THEN greatest(CASE WHEN budget > 0 THEN least(60.0, greatest(1.0, 0.10::DOUBLE * budget)) ELSE 60.0 END, 5.0 * med) END AS threshold FROM g)
SELECT file, status, reason, records, gap::DOUBLE AS seconds_since_last_progress,
       CASE WHEN NOT timed_out THEN NULL WHEN status = 'missing' THEN 'timeout_no_progress_records' WHEN status = 'invalid' THEN NULL WHEN wall IS NULL THEN 'timeout_progress_present_wall_unknown' WHEN gap >= threshold THEN 'timeout_long_gap_since_progress' ELSE 'timeout_recent_progress' END AS timeout_pattern
FROM t"""


def customer_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run per customer and the lines of its log, if it has one: the customer's events."""
    n, balance = F.col("c_nationkey"), F.col("c_acctbal")
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file"), F.when(balance < 0, None).when(n == 3, 0).otherwise(1).alias("size"), (n % 2 == 0).alias("timed_out"), F.when(n % 5 > 0, F.abs(balance)).alias("wall_seconds"), F.when(n % 3 == 0, F.lit(100.0) + n).alias("timeout_budget_seconds")
    )
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.lit(True).alias("terminated"), F.col("event_id").alias("processed"), F.lit(None).cast("long").alias("total"), F.col("event_id").cast("double").alias("elapsed_seconds"),
        F.lit(None).cast("string").alias("last_id"), F.col("value").alias("item_seconds"), F.col("event_type").alias("phase"), F.when(F.col("value") < 1, "invalid_item_seconds").alias("error"),
    )
    return runs, events.join(runs.where("size > 0").select("file"), "file", "left_semi")


@query(TIMEOUT_SQL)
def timeout_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per customer: missing, empty, invalid from the first small value on, or valid; then its time-out."""
    runs, there = customer_logs(spark, sf_dir)
    summary = progress.progress_summary(progress.monotony_errors(there), files=runs.select("file", "size"))
    return progress.timeout_pattern(summary.join(runs.drop("size"), "file")).select("file", "status", "reason", "records", "seconds_since_last_progress", "timeout_pattern")


@query("""
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'blank_line' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_progress_record' WHEN 3 THEN 'invalid_processed' WHEN 4 THEN CASE WHEN user_id < event_id THEN 'invalid_total' END
       WHEN 5 THEN 'invalid_last_id' WHEN 6 THEN 'invalid_phase' END AS error, CASE WHEN event_id % 9 = 2 THEN 1 WHEN event_id % 9 > 3 THEN event_id END AS processed FROM events""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the raw lines of a progress log, most of them wrong in some way."""
    n = F.col("event_id")
    head = F.concat(F.lit('{"schema":"descriptor-progress/1","processed":'), n, F.lit(',"elapsed_seconds":'), F.abs("value"))
    raw = _pick(
        n, " \t", F.concat(head, F.lit(",}")), '{"schema":"other/1","processed":1}', '{"schema":"descriptor-progress/1","processed":1.0,"elapsed_seconds":1}', F.concat(head, F.lit(',"total":'), "user_id", F.lit("}")),
        F.concat(head, F.lit(',"last_id":7}')), F.concat(head, F.lit(',"phase":[]}')), F.concat(head, F.lit(',"item_seconds":null,"phase":"x"}')), F.concat(head, F.lit("}")),
    )
    return progress.parsed_progress(table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))).select("event_id", "error", "processed")


@query("""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
     u AS (SELECT doc_id, text, unnest(p) AS raw, generate_subscripts(p, 1) AS line, len(p) AS n FROM l)
SELECT doc_id, line, octet_length(encode(raw)) AS n_bytes, line < n AS terminated FROM u WHERE line < n OR raw <> ''""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all texts by their physical numbers; the last one may lack its end."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines_of(F.col("text"))).alias("l"))
    return lines.select("doc_id", F.col("l.line").alias("line"), F.octet_length("l.raw").cast("long").alias("n_bytes"), F.col("l.terminated").alias("terminated"))


_PARTS = {  # of one document in so many: what stands after its head
    "4": ["}", ',"files":{}}', ',"changed_files":[]}', ',"changed_files":{"m.py":"x"},"delete_files":["a","a"]}', ',"delete_files":[1,2]}', ',"delete_files":[1,1.0]}', ',"delete_files":["old.py",null]}', ',"changed_files":{"../m.py":"x"}}', ',"changed_files":{"m.py":7}}', ',"changed_files":{"m.py":"x"},"delete_files":["BUNDLE_SOURCE.json"]}',
          ',"changed_files":{"m.py":"x"},"delete_files":["m.py"]}', ',"delete_files":["run_task.py"]}', ',"changed_files":{"m.py":"x"},"inputs":[]}', ',"changed_files":{"m.py":"x"},"timeout_seconds":30.0}', ',"changed_files":{"m.py":"x"},"timeout_seconds":29}', ',"changed_files":{"m.py":"x"},"delete_files":["old.py"],"timeout_seconds":1800}', ',"changed_files":{"m.py":"x"},"inputs":{"m.py":{"path":"inputs/a"}}}', ',"changed_files":{"m.py":"x"}'],
    "2": [',"files":{"run_task.py":"$P"}}', ',"files":{"m.py":"$P"}}', ',"files":{}}', ',"files":{"run_task.py":"x","a/b":"y"}}', ',"files":{"run_task.py":1}}', ',"files":{"run_task.py":"$P"},"sha256":{"run_task.py":"$H"}}', ',"files":{"run_task.py":"$P"},"sha256":{}}'],
}
_LIST = lambda parts: "[" + ", ".join("'" + x + "'" for x in parts) + "]"
_NAME = "regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9_.\\-]{{0,95}}') AND {0} <> 'BUNDLE_SOURCE.json'"


@query(f"""
WITH k AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '4' ELSE '3' END AS tag, {_LIST(_PARTS["2"])} AS whole, {_LIST(_PARTS["4"])} AS parts FROM orders),
     r AS (SELECT o_orderkey, 'bt-' || o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN '{{"schema":"private-task-bundle/9","bundle_id":"bt-' || o_orderkey || '"' ELSE '{{"schema":"private-task-bundle/' || tag || '","bundle_id":"bt-' || CASE WHEN o_totalprice < 5000 THEN o_orderkey + 1 ELSE o_orderkey END || '"' END
               || CASE WHEN tag = '4' THEN ',"base_source_ref":"' || CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'abc' ELSE sha1(o_orderpriority) END || '"' || parts[o_orderkey % len(parts) + 1]
                       ELSE replace(replace(whole[o_orderkey % len(whole) + 1], '$P', o_orderpriority), '$H', sha256(CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END)) END AS raw FROM k),
     v AS (SELECT o_orderkey, id, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw::JSON END AS d FROM r),
     t AS (SELECT *, d->>'$.schema' AS schema, json_type(d, '$.changed_files') AS kc, json_type(d, '$.delete_files') AS kd, json_type(d, '$.files') AS kf, json_type(d, '$.sha256') AS kh, json_type(d, '$.inputs') AS ki, json_type(d, '$.timeout_seconds') AS kt FROM v),
     n AS (SELECT *, CASE WHEN kc = 'OBJECT' THEN json_keys(d, '$.changed_files') ELSE [] END AS cs, CASE WHEN kd = 'ARRAY' THEN list_transform((d->'$.delete_files')::JSON[], lambda x: CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (x::DOUBLE)::VARCHAR ELSE coalesce(x::VARCHAR, 'null') END) ELSE [] END AS ds,
                  CASE WHEN kf = 'OBJECT' THEN json_keys(d, '$.files') ELSE [] END AS fs, CASE WHEN kh = 'OBJECT' THEN json_keys(d, '$.sha256') ELSE [] END AS hs, CASE WHEN ki = 'OBJECT' THEN json_keys(d, '$.inputs') ELSE [] END AS ins FROM t),
     b AS (SELECT *, list_filter(list_transform(ds, lambda x: CASE WHEN starts_with(x, '"') THEN x[2:-2] END), lambda x: x IS NOT NULL) AS names,
                  len(list_filter(cs, lambda x: NOT ({_NAME.format("x")}) OR json_type(d->'$.changed_files'->x) <> 'VARCHAR')) > 0 AS bad_c, len(list_filter(fs, lambda x: NOT ({_NAME.format("x")}) OR json_type(d->'$.files'->x) <> 'VARCHAR')) > 0 AS bad_f,
                  len(list_filter(fs, lambda x: sha256(d->'$.files'->>x) IS DISTINCT FROM (d->'$.sha256'->>x))) > 0 AS bad_h FROM n),
     e AS (SELECT *, CASE WHEN kf IS NOT NULL OR kh IS NOT NULL THEN 'successor_ambiguous_source_fields' WHEN NOT regexp_full_match(d->>'$.base_source_ref', '[0-9a-f]{{40}}') THEN 'invalid_base_source_ref' WHEN kc <> 'OBJECT' THEN 'invalid_changed_files'
                  WHEN kd IS NOT NULL AND (kd <> 'ARRAY' OR len(list_distinct(ds)) <> len(ds)) THEN 'invalid_delete_files' WHEN len(cs) = 0 AND len(ds) = 0 THEN 'successor_no_requested_changes' WHEN bad_c THEN 'invalid_changed_source_entry'
                  WHEN len(names) < len(ds) OR len(list_filter(names, lambda x: NOT ({_NAME.format("x")}))) > 0 THEN 'invalid_delete_source_entry' WHEN list_has_any(cs, names) THEN 'successor_change_delete_overlap' WHEN list_contains(names, 'run_task.py') THEN 'cannot_delete_run_task' END AS succ,
                  CASE WHEN kf IS DISTINCT FROM 'OBJECT' OR len(fs) = 0 THEN 'invalid_source_files' WHEN NOT list_contains(fs, 'run_task.py') THEN 'invalid_source_manifest' WHEN (ends_with(schema, '/2') OR kh IS NOT NULL) AND (kh IS DISTINCT FROM 'OBJECT' OR NOT (list_has_all(fs, hs) AND list_has_all(hs, fs))) THEN 'invalid_source_manifest'
                  WHEN bad_f THEN 'invalid_source_entry' WHEN (ends_with(schema, '/2') OR kh IS NOT NULL) AND bad_h THEN 'source_hash_mismatch' END AS own FROM b)
SELECT o_orderkey, CASE WHEN NOT ok THEN 'invalid_bundle_json' WHEN schema NOT IN ('private-task-bundle/2', 'private-task-bundle/3', 'private-task-bundle/4') OR d->>'$.bundle_id' <> id THEN 'bundle_identity_mismatch'
       ELSE coalesce(CASE WHEN ends_with(schema, '/4') THEN succ ELSE own END, CASE WHEN ki <> 'OBJECT' THEN 'invalid_inputs' WHEN list_has_any(ins, cs) THEN 'invalid_input_entry' WHEN kt IS NOT NULL AND (kt NOT IN ('UBIGINT', 'BIGINT') OR (d->>'$.timeout_seconds')::DOUBLE NOT BETWEEN 30 AND 1800) THEN 'invalid_timeout' END) END AS error, schema FROM e""")
def bundle_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bundle documents, each judged from its text; the SQL reads the same texts."""
    c, k = F.col, F.col("o_orderkey")
    name, price = F.concat(F.lit("bt-"), k), F.col("o_totalprice")
    tag = F.when(c("o_orderstatus") == "F", "2").when(c("o_orderstatus") == "O", "4").otherwise("3")
    head = F.when(price > 400000, F.concat(F.lit('{"schema":"private-task-bundle/9","bundle_id":"'), name, F.lit('"'))).otherwise(
        F.concat(F.lit('{"schema":"private-task-bundle/'), tag, F.lit('","bundle_id":"bt-'), F.when(price < 5000, k + 1).otherwise(k), F.lit('"'))
    )
    ref = F.when((c("o_orderpriority") == "1-URGENT") & (k % 2 == 0), "abc").otherwise(F.sha1("o_orderpriority"))
    digest = F.sha2(F.when(c("o_custkey") % 2 == 0, c("o_orderpriority")).otherwise(c("o_orderstatus")), 256)
    whole = F.replace(F.replace(_pick(k, *_PARTS["2"]), F.lit("$P"), c("o_orderpriority")), F.lit("$H"), digest)
    tail = F.when(tag == "4", F.concat(F.lit(',"base_source_ref":"'), ref, F.lit('"'), _pick(k, *_PARTS["4"]))).otherwise(whole)
    bundles = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(head, tail).alias("raw"), name.alias("bundle_id"))
    return contracts.bundle_verdicts(bundles).select("o_orderkey", "error", "schema")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN 'run_request_identity_mismatch' WHEN 1 THEN 'invalid_run_source_ref' WHEN 2 THEN 'run_request_cannot_edit_source' WHEN 3 THEN 'invalid_input_entry'
       ELSE CASE WHEN CAST(l_quantity AS INT) * 40 NOT BETWEEN 30 AND 1800 THEN 'invalid_timeout' WHEN l_partkey % 7 = 4 THEN 'invalid_run_config' END END AS error FROM lineitem""")
def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as run requests."""
    k, ref = F.col("l_partkey"), F.sha1(F.col("l_returnflag"))
    spec = F.struct(F.lit("inputs/a").alias("path"), ref.alias("ref"), ref.alias("blob"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k % 7 == 2, F.array(F.lit("config"), F.lit("files"))).otherwise(F.array(F.lit("config"))).alias("keys"), F.lit("private-run-request/1").alias("schema"), F.lit("bt-1").alias("bundle_id"),
        F.when(k % 7 == 0, "bt-2").otherwise("bt-1").alias("wanted_id"), F.when(k % 7 == 1, "x").otherwise(ref).alias("source_ref"), F.create_map(F.when(k % 7 == 3, "BUNDLE_SOURCE.json").otherwise("a.json"), spec).alias("inputs"),
        (F.col("l_quantity").cast("int") * 40).alias("timeout_seconds"), F.when(k % 7 == 4, "[1]").otherwise('{"a":1}').alias("config_json"),
    )
    return contracts.run_request_errors(rows).select("l_orderkey", "l_linenumber", "error")


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'input_source_name_collision' WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 'run_config_source_collision' END AS error, regexp_full_match(p_brand || '/' || p_name, '[A-Za-z0-9_.\\-]+/[A-Za-z0-9_.\\-]+') AS repository,
       greatest(10, least(40, p_size)) AS clamped FROM part""")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as runs whose inputs or configuration hide a source; brand and name as a repository's."""
    n = F.col("p_size") % 4
    inputs = F.array(F.lit("a.json"), F.when(n == 0, "run_task.py").otherwise("b.json"))
    sources = F.array(F.lit("run_task.py"), F.when(n == 1, "run_config.json").otherwise("c.py"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", contracts.name_collision(inputs, sources, F.col("p_partkey") % 2 == 0).alias("error"), fn.safe_repository(F.concat_ws("/", F.regexp_replace("p_brand", "#", "#"), "p_name")).alias("repository"), fn.clamp(F.col("p_size"), F.lit(10), F.lit(40)).alias("clamped")
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'result_identity_mismatch' WHEN o_orderstatus = 'F' AND o_orderkey % 6 = 1 THEN 'false_completion_rejected' WHEN o_orderkey = 0 OR o_orderkey % 6 = 2 THEN 'producer_identity_mismatch'
       WHEN o_orderkey % 6 = 3 THEN 'invalid_result_manifest' WHEN o_orderkey % 6 = 4 AND o_orderpriority = '5-LOW' THEN 'invalid_result_manifest_entry' END AS error FROM orders""")
def receipt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts of runs."""
    k = F.col("o_orderkey")
    digest = F.sha2("o_orderpriority", 256)
    files = F.when(k % 6 != 3, F.create_map(F.when(F.col("o_orderpriority") == "5-LOW", F.when(k % 6 == 4, "receipt.json").otherwise("low.json")).otherwise("result.jsonl"), digest))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("bundle-computation-receipt/2").alias("schema"), F.lit("b").alias("bundle_id"), F.lit("x").alias("bundle_blob"), F.sha1("o_orderpriority").alias("source_ref"), F.when(F.col("o_orderstatus") == "F", "materialized").otherwise("failed_or_partial").alias("status"),
        F.when(k % 6 == 1, 1).alias("collection_errors"), k.cast("string").alias("run_id"), F.lit("1").alias("run_attempt"), files.alias("files"), F.when(k % 6 == 0, "c").otherwise("b").alias("wanted_id"), F.lit("x").alias("wanted_blob"), F.when(k % 6 == 2, "7-7-7").alias("producer"),
    )
    return contracts.receipt_errors(rows).select("o_orderkey", "error")


@query("""
WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'receipt.json' WHEN 1 THEN ' ' WHEN 2 THEN '..' ELSE regexp_extract(url, '([^/]*)$', 1) END AS name FROM pages)
SELECT page_id, CASE WHEN trim(name) = '' OR name IN ('.', '..') OR contains(name, '/') OR contains(name, chr(92)) THEN 'invalid_output_name' WHEN name IN ('receipt.json', 'admission.json') THEN 'reserved_output_name' END AS saved_error,
       CASE WHEN name IN ('receipt.json', 'admission.json') THEN 'reserved_name' WHEN name IN ('', '.', '..') OR contains(name, '/') OR contains(name, chr(92)) THEN 'invalid_filename' END AS collected_error FROM n""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of page addresses as output names, among names that are none."""
    name = F.when(F.col("page_id") % 5 == 0, "receipt.json").when(F.col("page_id") % 5 == 1, " ").when(F.col("page_id") % 5 == 2, "..").otherwise(F.element_at(F.split("url", "/"), -1))
    return table(spark, sf_dir, "pages").select("page_id", contracts.output_name_error(name).alias("saved_error"), contracts.collected_name_error(name).alias("collected_error"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 6 = 0 THEN 'push_must_contain_one_commit' WHEN l_suppkey % 6 = 1 THEN 'push_must_change_one_trigger' WHEN l_suppkey % 6 = 2 THEN 'trigger_commit_must_be_isolated' WHEN l_suppkey % 6 = 3 THEN 'trigger_file_removed' END AS error,
       CASE WHEN l_suppkey % 6 > 3 THEN printf('private_job/slots/ml-%02d.json', l_linenumber) END AS path FROM lineitem""")
def push_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pushes that touch a slot's file, and other things besides."""
    n, slot = F.col("l_suppkey") % 6, F.format_string("private_job/slots/ml-%02d.json", F.col("l_linenumber"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n == 0, 2).otherwise(1).alias("commits"), F.when(n == 1, F.array(F.lit("private_job/request.json"))).when(n == 2, F.array(F.lit("README"))).otherwise(none).alias("added"),
        F.when(n == 3, none).otherwise(F.array(slot)).alias("modified"), F.when(n == 3, F.array(slot)).otherwise(none).alias("removed"),
    )
    return contracts.push_triggers(rows).select("l_orderkey", "l_linenumber", "error", "path")


@query("""
SELECT event_id, user_id AS path, event_type AS status FROM events WHERE event_type = 'error' OR user_id + 100 NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def outside_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes; customers of four segments are what was delivered, errors are removals."""
    changes = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") + 100).alias("path"), F.when(F.col("event_type") == "error", "removed").otherwise("added").alias("status"), "event_type")
    delivered = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("path"))
    return lifecycle.outside_delivery(changes, delivered, "path").select("event_id", (F.col("path") - 100).alias("path"), F.col("event_type").alias("status"))


@query("""
WITH p AS (SELECT page_id, html, CASE WHEN page_id % 4 = 1 THEN 'none' ELSE 'base64' END AS encoding, CASE WHEN page_id % 4 = 2 THEN sha1(html) ELSE sha1(encode('blob ' || octet_length(encode(html))) || '\\x00'::BLOB || encode(html)) END AS sha FROM pages)
SELECT page_id, CASE WHEN html IS NULL OR encoding = 'none' THEN 'expected_base64_file' WHEN octet_length(encode(html)) > 20000 THEN 'file_too_large' WHEN page_id % 4 = 2 THEN 'blob_identity_mismatch' END AS error,
       CASE WHEN encoding = 'base64' AND octet_length(encode(html)) <= 20000 AND page_id % 4 <> 2 THEN sha256(html) END AS digest FROM p""")
def decoded_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored base64 files: some aren't, some are too large, some have another identity."""
    n, raw = F.col("page_id") % 4, F.encode("html", "utf-8")
    items = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("file").alias("type"), F.when(n == 1, "none").otherwise("base64").alias("encoding"), F.regexp_replace(F.base64(raw), "(.{76})", "$1\n").alias("content"), F.when(n == 2, F.sha1("html")).otherwise(fn.blob_id(F.col("html"))).alias("sha")
    )
    return contracts.decoded_files(items, 20_000).select("page_id", "error", F.sha2("raw", 256).alias("digest"))


@query("""
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, coalesce(sum(octet_length(encode(html))), 0)::BIGINT AS total_bytes FROM pages GROUP BY 1)
SELECT host, total_bytes, CASE WHEN total_bytes > 30000 THEN 'total_size_exceeded' END AS error FROM h""")
def size_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a host together, against a limit."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "html")
    return contracts.over_total(pages, "host", F.octet_length("html"), 30_000)


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, 'c' || o_custkey AS ref, CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE 'c' || o_custkey END AS wanted FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN wanted <> ref THEN 'request_result_source_mismatch' END WHEN c_custkey IS NULL OR c_mktsegment = 'BUILDING' THEN 'source_request_identity_mismatch' END AS error
FROM r LEFT JOIN customer ON c_custkey + 5 = o_custkey""")
def source_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts, of run requests or of bundles whose manifests the customers are."""
    ref = F.concat(F.lit("c"), F.col("o_custkey"))
    receipts = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "private-run-request/1").otherwise("private-task-bundle/2").alias("request_schema"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(ref).alias("request_source_ref"), F.lit("b").alias("bundle_id"), ref.alias("bundle_blob"), ref.alias("source_ref")
    )
    key = F.concat(F.lit("c"), F.col("c_custkey") + 5)
    manifests = table(spark, sf_dir, "customer").select(key.alias("source_ref"), F.lit("b").alias("bundle_id"), F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(key).alias("bundle_blob"))
    return contracts.source_bindings(receipts, manifests).select("o_orderkey", "error")


@query("""
WITH l AS (SELECT sha1(l_orderkey::VARCHAR) AS commit, l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 2 THEN 'run_task.py' WHEN l_tax > 0.07 THEN 'm' || l_linenumber || '/x.py' ELSE 'm' || l_linenumber || '.py' END AS name, l_returnflag AS f, l_discount AS d FROM lineitem),
     g AS (SELECT commit, any_value(k) AS k, count(*) FILTER (n = 1) AS manifests, max((n = 2)::INT) AS runs, max((n > 1 AND f = 'R')::INT) AS odd FROM l GROUP BY commit),
     e AS (SELECT DISTINCT commit, name, sha256(CASE WHEN d > 0.09 THEN 'x' ELSE f || n END) AS want FROM l WHERE n > 1), h AS (SELECT commit, name, sha256(f || n) AS have FROM l WHERE n > 1),
     b AS (SELECT e.commit, e.name, CASE WHEN contains(e.name, '/') THEN 'invalid_base_source_entry' WHEN have <> want THEN 'base_source_hash_mismatch' END AS error FROM e JOIN h ON h.commit = e.commit AND h.name = e.name),
     w AS (SELECT commit, min({'name': name, 'error': error}).error AS bad FROM b WHERE error IS NOT NULL GROUP BY commit)
SELECT g.commit, CASE WHEN manifests = 1 THEN 'bt-' || k END AS bundle_id, CASE WHEN manifests <> 1 THEN 'base_source_manifest_not_unique' WHEN coalesce(o_orderstatus, 'P') = 'P' THEN 'invalid_base_source_manifest' WHEN runs = 0 THEN 'invalid_base_source_files'
       WHEN bad IS NOT NULL THEN bad WHEN odd = 1 THEN 'base_source_commit_scope_mismatch' END AS error FROM g LEFT JOIN w USING (commit) LEFT JOIN orders ON o_orderkey = k""")
def base_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: line 1 is the manifest, the others its files; returned ones lie elsewhere, highly discounted ones have other content."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    m = F.concat(F.lit("m"), n.cast("string"))
    name = F.when(n == 2, "run_task.py").when(F.col("l_tax") > 0.07, F.concat(m, F.lit("/x.py"))).otherwise(F.concat(m, F.lit(".py")))
    folder, text = F.concat(F.lit(contracts.MATERIALIZED + "/bt-"), k.cast("string"), F.lit("/")), F.concat("l_returnflag", n.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.sha1(k.cast("string")).alias("commit"), n.alias("n"), name.alias("name"), F.when(n == 1, F.concat(folder, F.lit("BUNDLE_SOURCE.json"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("elsewhere/"), name)).otherwise(F.concat(folder, name)).alias("changed"),
        F.concat(folder, name).alias("path"), text.alias("content"), F.sha2(F.when(F.col("l_discount") > 0.09, "x").otherwise(text), 256).alias("sha256"),
    )
    heads = table(spark, sf_dir, "orders").select(F.sha1(F.col("o_orderkey").cast("string")).alias("commit"), F.when(F.col("o_orderstatus") == "P", "other/1").otherwise(contracts.SOURCE_SCHEMAS[0]).alias("schema"), F.concat(F.lit("bt-"), "o_orderkey").alias("bundle_id"))
    files = rows.where("n > 1")
    return contracts.base_sources(rows.select("commit", F.col("changed").alias("path")), files.select("commit", "name", "sha256"), heads, files.select("commit", "path", F.encode("content", "utf-8").alias("content")))


@query("""
SELECT o_orderkey::VARCHAR AS run_id, 'private-review-submission/1' AS schema, CASE WHEN o_orderstatus = 'F' THEN 'materialized' ELSE 'failed_or_partial' END AS execution_status, 'transport/bundle-executions/bt-' || o_custkey || '/' || o_orderkey || '-1/receipt.json' AS receipt_path,
       CASE WHEN o_orderstatus <> 'P' THEN 'transport/bundle-executions/bt-' || o_custkey || '/' || o_orderkey || '-1/result.jsonl' END AS result_path, 'private-run-request/1' AS draft_schema, sha1(o_orderpriority) AS inputs_from, 'pending' AS scientific_review_status, o_orderpriority AS stage, CASE WHEN o_totalprice > 100000 THEN 2 ELSE 0 END AS validation_error_count, 'published' AS publication_status, 'not_claimed' AS scientific_completion, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS exit_code FROM orders""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: their receipts, the review queue's rows and the drafts of the runs after them."""
    digest = F.sha2("o_orderpriority", 256)
    files = F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("log"), digest)).otherwise(F.create_map(F.lit("result.jsonl"), digest, F.lit("log"), digest))
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("bt-"), "o_custkey").alias("bundle_id"), F.sha1("o_orderpriority").alias("bundle_blob"), F.sha1("o_orderstatus").alias("source_ref"), F.col("o_orderkey").cast("string").alias("run_id"), F.lit("1").alias("run_attempt"),
        files.alias("files"), F.lit(1).alias("result_rows"), (F.col("o_orderstatus") == "F").alias("done"),
        F.col("o_orderpriority").alias("stage"), F.when(F.col("o_totalprice") > 100000, F.array(F.lit("a"), F.lit("b"))).alias("validation_errors"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"),
    )
    receipts = contracts.receipt_rows(runs)
    drafts = contracts.run_drafts(receipts.select("bundle_id", "source_ref", "bundle_blob", "run_id")).select(F.col("schema").alias("draft_schema"), "bundle_id", "inputs_from").distinct()
    reviews = contracts.review_rows(receipts).join(receipts.select("run_id", "publication_status", "scientific_completion", F.col("execution_status.exit_code").alias("exit_code")), "run_id")
    out = reviews.join(drafts.withColumnRenamed("inputs_from", "blob"), (reviews.bundle_id == drafts.bundle_id) & (reviews.bundle_blob == F.col("blob")))
    return out.select("run_id", "schema", "execution_status", "receipt_path", "result_path", "draft_schema", F.col("blob").alias("inputs_from"), "scientific_review_status", "stage", "validation_error_count", "publication_status", "scientific_completion", "exit_code")


@query("SELECT o_orderpriority AS method, count(*) AS trials, median(o_totalprice) AS median_seconds FROM orders GROUP BY 1")
def method_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as timed trials of their priorities."""
    return progress.method_medians(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("seconds")))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 3 AS n FROM lineitem), s AS (SELECT l_orderkey, min(l_linenumber) FILTER (n < 100) AS last FROM p GROUP BY 1)
SELECT p.l_orderkey, sum(n)::BIGINT AS items FROM p JOIN s USING (l_orderkey) WHERE last IS NULL OR l_linenumber <= last GROUP BY 1""")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the pages of a listing that ends with the first short one."""
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sequence(F.lit(1), F.col("l_quantity").cast("int") * 3).alias("items"))
    return paged(pages, "l_orderkey", "l_linenumber", "items").groupBy("l_orderkey").agg(F.count("*").alias("items"))


@query("""
WITH b AS (SELECT doc_id, text, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob, octet_length(encode(text)) AS size FROM documents),
     q AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN sha1('x') WHEN doc_id % 5 = 1 THEN blob END AS expected, CASE WHEN doc_id % 2 = 0 THEN 400 END AS size_limit FROM b),
     e AS (SELECT q.*, CASE WHEN l.doc_id IS NULL THEN 'missing_repository_object' WHEN toxic = 1 THEN 'expected_file' WHEN expected <> blob THEN 'pinned_file_identity_mismatch' WHEN size > size_limit THEN 'file_too_large'
                  WHEN quality = 0 AND doc_id % 4 = 0 THEN 'blob_identity_mismatch' END AS error FROM q LEFT JOIN labels l USING (doc_id))
SELECT doc_id, error, CASE WHEN error IS NULL THEN blob END AS blob, CASE WHEN error IS NULL THEN sha256(text) END AS digest FROM e""")
def pinned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by identity and size in a snapshot of the labelled ones: toxic ones are folders, every other one is held by its blob alone, some poor ones have other content."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    blob, raw = fn.blob_id(F.col("text")), F.encode("text", "utf-8")
    requests = docs.select("doc_id", F.lit("main").alias("ref"), d.cast("string").alias("path"), F.when(d % 5 == 0, F.sha1(F.lit("x"))).when(d % 5 == 1, blob).alias("expected_blob"), F.when(d % 2 == 0, 400).alias("size_limit"))
    content = F.when((F.col("quality") == 0) & (d % 4 == 0), F.encode(F.concat("text", F.lit("x")), "utf-8")).otherwise(raw)
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumns({"sha": blob, "content": content})
    held = rows.select(F.lit("main").alias("ref"), d.cast("string").alias("path"), F.when(F.col("toxic") == 1, "tree").otherwise("blob").alias("type"), "sha", F.octet_length("text").alias("size"), F.when(d % 4 < 2, F.col("content")).alias("content"))
    blobs = rows.where(d % 4 >= 2).select("sha", "content").distinct()
    return snapshots.pinned_reads(requests, held, blobs).select("doc_id", "error", "blob", F.sha2("content", 256).alias("digest"))


@query("""
WITH l AS (SELECT p_partkey, 'pkg==' || p_size || chr(10) || CASE p_partkey % 6 WHEN 0 THEN 'PKG==1' WHEN 1 THEN 'other>=2' ELSE 'other==2' END || CASE WHEN p_partkey % 6 = 2 THEN '' ELSE chr(10) END AS text FROM part)
SELECT p_partkey AS file, 2::BIGINT AS package_count, CASE p_partkey % 6 WHEN 0 THEN 'duplicate_distribution' WHEN 1 THEN 'not_exact_pin' WHEN 2 THEN 'missing_final_newline' WHEN 3 THEN 'lock_hash_mismatch' WHEN 4 THEN 'package_count_mismatch' END AS error, sha256(text) AS sha256 FROM l""")
def lock_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lock files of two pins."""
    k = F.col("p_partkey")
    second = F.when(k % 6 == 0, "PKG==1").when(k % 6 == 1, "other>=2").otherwise("other==2")
    text = F.concat(F.lit("pkg=="), F.col("p_size"), F.lit("\n"), second, F.when(k % 6 == 2, "").otherwise("\n"))
    locks = table(spark, sf_dir, "part").select(k.alias("file"), text.alias("text"), F.sha2(F.when(k % 6 == 3, "x").otherwise(text), 256).alias("expected_sha256"), F.when(k % 6 == 4, 3).otherwise(2).alias("expected_count"))
    return lock_verdicts(locks)


@query("""
WITH s AS (SELECT source, lang, max(toxic) AS toxic, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang),
     o AS (SELECT source, lang, CASE WHEN toxic IS NULL THEN 'missing_delete' WHEN toxic = 1 THEN 'deleted' WHEN even * 2 > n THEN 'changed' WHEN even > 0 THEN 'unchanged' ELSE 'inherited' END AS status FROM s)
SELECT source, CASE WHEN bool_or(status = 'missing_delete') THEN 'successor_delete_missing_file' WHEN NOT bool_or(status NOT IN ('missing_delete', 'deleted') AND lang = 'en') THEN 'invalid_final_source_manifest'
       WHEN NOT bool_or(status IN ('changed', 'deleted')) THEN 'successor_no_effect' END AS error FROM o GROUP BY source""")
def overlay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as successors whose files are their languages, English being the entry point."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    even = F.count_if(F.col("doc_id") % 2 == 0)
    per = labelled.groupBy("source", "lang").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"), even.alias("even"))
    status = F.when(F.col("toxic").isNull(), "missing_delete").when(F.col("toxic") == 1, "deleted").when(F.col("even") * 2 > F.col("n"), "changed").when(F.col("even") > 0, "unchanged").otherwise("inherited")
    rows = per.select("source", F.when(F.col("lang") == "en", "run_task.py").otherwise(F.col("lang")).alias("name"), status.alias("status"))
    return snapshots.overlay_verdicts(rows, "source", "name")


@query("""
WITH e AS (SELECT o_orderpriority AS snapshot, 'c' || o_custkey || '/o' || o_orderkey AS path, sha1(o_orderkey::VARCHAR) AS sha FROM orders), t AS (SELECT DISTINCT o_orderpriority AS snapshot, 'c' || o_custkey AS folder, o_orderpriority = '5-LOW' AS cut FROM orders)
SELECT t.snapshot, t.folder, CASE WHEN NOT cut THEN e.path END AS path, CASE WHEN NOT cut THEN e.sha END AS sha, CASE WHEN cut THEN 'incomplete_git_tree' END AS error FROM t JOIN e ON e.snapshot = t.snapshot AND split_part(e.path, '/', 1) = t.folder WHERE NOT cut
UNION ALL SELECT snapshot, folder, NULL, NULL, 'incomplete_git_tree' FROM t WHERE cut
UNION ALL SELECT snapshot, path, NULL, NULL, CASE WHEN snapshot = '5-LOW' THEN 'incomplete_git_tree' ELSE 'expected_result_directory' END FROM e""")
def folder_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files in their customers' folders, a snapshot per priority; one of the snapshots is truncated, and files are asked for as folders."""
    orders = table(spark, sf_dir, "orders")
    folder = F.concat(F.lit("c"), "o_custkey")
    files = orders.select(F.col("o_orderpriority").alias("snapshot"), F.concat(folder, F.lit("/o"), "o_orderkey").alias("path"), F.lit("blob").alias("type"), F.sha1(F.col("o_orderkey").cast("string")).alias("sha"))
    folders = orders.select(F.col("o_orderpriority").alias("snapshot"), folder.alias("path"), F.lit("tree").alias("type"), F.lit(None).cast("string").alias("sha")).distinct()
    asked = files.union(folders).select("snapshot", F.col("path").alias("folder"))
    cut = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderpriority").alias("snapshot"))
    return snapshots.folder_entries(asked, files.union(folders), cut).select("snapshot", "folder", "path", "sha", "error")


@query("""
SELECT conv_id, turn, 'restricted-exec-status/1' AS schema, octet_length(encode(text))::BIGINT AS stdout_bytes, sha256(text) AS stdout_sha256, octet_length(encode(role))::BIGINT AS stderr_bytes, sha256(role) AS stderr_sha256 FROM conversations""")
def execution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as executions: text and role are what they printed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("stdout"), F.col("role").alias("stderr"))
    return results.public_status(turns)


@query("""
WITH l AS (SELECT l_orderkey AS k, 'm' || l_linenumber || '.py' AS name, max(l_returnflag) AS old, max(l_linestatus) = 'F' AS edited, max(l_discount) > 0.05 AS other, max(l_tax) > 0.06 AND max(l_linestatus) <> 'F' AS gone FROM lineitem GROUP BY 1, 2),
     o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
     x AS (SELECT k, name, CASE WHEN edited AND other THEN old || '!' ELSE old END AS text, edited, other, gone, st = 'P' AS succ FROM l JOIN o USING (k) UNION ALL SELECT k, 'n.py', k::VARCHAR, true, true, false, true FROM o WHERE st = 'P'),
     f AS (SELECT k, string_agg(name || '=' || sha256(CASE WHEN succ THEN text ELSE replace(text, '!', '') END), ',' ORDER BY name) FILTER (NOT (succ AND gone)) AS files,
                  string_agg(name, ',' ORDER BY name) FILTER (succ AND edited) AS requested, string_agg(name, ',' ORDER BY name) FILTER (succ AND edited AND other) AS actual, string_agg(name, ',' ORDER BY name) FILTER (succ AND edited AND NOT other) AS unchanged,
                  string_agg(name, ',' ORDER BY name) FILTER (succ AND gone) AS deleted, string_agg(name, ',' ORDER BY name) FILTER (succ AND NOT gone AND NOT (edited AND other)) AS inherited FROM x GROUP BY k)
SELECT 'bt-' || o.k AS bundle_id, CASE WHEN st = 'P' THEN 'bundle-materialized-source/3' ELSE 'bundle-materialized-source/2' END AS schema, 'transport/bundle_inbox/bt-' || o.k || '.json' AS bundle_path, sha1(o.k::VARCHAR) AS bundle_blob, coalesce(files, '') AS files, 600::BIGINT AS timeout_seconds,
       CASE st WHEN 'O' THEN 'private-task-bundle/3' WHEN 'P' THEN 'private-task-bundle/4' END AS submission_schema, CASE st WHEN 'O' THEN 'actions_received_utf8' WHEN 'P' THEN 'actions_received_utf8_overlay' END AS source_hash_authority,
       CASE WHEN st = 'P' THEN sha1(pr) END AS parent_source_ref, CASE WHEN st = 'P' THEN 'bt-base' END AS parent_bundle_id, CASE WHEN st = 'P' THEN coalesce(requested, '') END AS requested, CASE WHEN st = 'P' THEN coalesce(actual, '') END AS actual, CASE WHEN st = 'P' THEN coalesce(unchanged, '') END AS unchanged,
       CASE WHEN st = 'P' THEN coalesce(deleted, '') END AS deleted, CASE WHEN st = 'P' THEN coalesce(inherited, '') END AS inherited FROM o LEFT JOIN f USING (k)""")
def source_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as materialised bundles of three schemas, their lines as files; successors change, repeat, delete and add some."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("m"), "l_linenumber", F.lit(".py")).alias("name")).agg(
        F.max("l_returnflag").alias("old"), (F.max("l_linestatus") == "F").alias("edited"), (F.max("l_discount") > 0.05).alias("other"), ((F.max("l_tax") > 0.06) & (F.max("l_linestatus") != "F")).alias("gone")
    )
    entry = lambda value: F.struct(c("name").alias("key"), value.alias("value"))
    listed = lambda value, when: F.collect_list(F.when(when, value))  # noqa: E731  the lines of one order
    text = F.when(c("other"), F.concat("old", F.lit("!"))).otherwise(c("old"))
    per = lines.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(listed(entry(c("old")), F.lit(True))).alias("all"), F.map_from_entries(listed(entry(text), c("edited"))).alias("edits"), listed(c("name"), c("gone")).alias("gone"))
    none, successor = F.create_map().cast("map<string,string>"), c("o_orderstatus") == "P"
    rows = table(spark, sf_dir, "orders").join(per, "o_orderkey", "left").select(
        F.concat(F.lit("bt-"), "o_orderkey").alias("bundle_id"), F.when(c("o_orderstatus") == "O", "private-task-bundle/3").when(successor, "private-task-bundle/4").otherwise("private-task-bundle/2").alias("bundle_schema"),
        F.sha1(c("o_orderkey").cast("string")).alias("bundle_blob"), F.sha1("o_orderpriority").alias("base_source_ref"), F.lit("bt-base").alias("base_bundle_id"), F.lit(600).cast("long").alias("timeout_seconds"), c("all").alias("base_files"), c("gone").alias("delete_files"),
        F.when(successor, F.map_concat(F.coalesce("edits", none), F.create_map(F.lit("n.py"), c("o_orderkey").cast("string")))).otherwise(c("all")).alias("files"),
    )
    found = contracts.source_manifests(rows)
    files = F.array_join(F.transform(F.map_entries("files"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    lists = {"requested": "requested_changed_files", "actual": "actual_changed_files", "unchanged": "unchanged_overlay_files", "deleted": "deleted_files", "inherited": "inherited_files"}
    return found.select("bundle_id", "schema", "bundle_path", "bundle_blob", files.alias("files"), "timeout_seconds", "submission_schema", "source_hash_authority", "parent_source_ref", "parent_bundle_id", *(F.array_join(f"successor.{v}", ",").alias(k) for k, v in lists.items()))


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'run' WHEN 'O' THEN 'bundle' ELSE 'other' END AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 'none' WHEN '5-LOW' THEN 'bad' ELSE 'up' END AS p FROM orders),
     c AS (SELECT k AS root, k, 0 AS depth, s, p FROM o WHERE s = 'run' UNION ALL SELECT c.root, c.k - 1, depth + 1, o.s, o.p FROM c LEFT JOIN o ON o.k = c.k - 1 WHERE c.s = 'run' AND c.p = 'up'),
     f AS (SELECT root, max(CASE WHEN s IS NULL THEN 'missing_repository_object' WHEN s = 'other' THEN 'inputs_from_not_a_request' WHEN s = 'run' AND p = 'bad' THEN 'invalid_inputs_from' END) AS fault FROM c GROUP BY root),
     n AS (SELECT root, 'i' || k % 3 || '.json' AS name, arg_min(k, depth) AS k FROM c WHERE s IS NOT NULL GROUP BY 1, 2),
     m AS (SELECT root, string_agg(name || '=inputs/' || k, ',' ORDER BY name) AS inputs FROM n GROUP BY root)
SELECT root AS o_orderkey, fault AS error, CASE WHEN fault IS NULL THEN inputs END AS inputs FROM f JOIN m USING (root)""")
def run_request_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests that take over the inputs of the order before them; the finished ones are judged as runs."""
    c, ref = F.col, F.sha1(F.col("o_orderkey").cast("string"))
    source = F.when(c("o_orderpriority") == "5-LOW", "no blob").when(c("o_orderpriority") != "1-URGENT", F.sha1((c("o_orderkey") - 1).cast("string")))
    schema = F.when(c("o_orderstatus") == "F", snapshots.RUN_SCHEMA).when(c("o_orderstatus") == "O", snapshots.REQUEST_SCHEMAS[1]).otherwise("other/1")
    spec = F.struct(F.concat(F.lit("inputs/"), "o_orderkey").alias("path"), ref.alias("ref"), ref.alias("blob"))
    saved = table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("blob"), schema.alias("schema"), source.alias("inputs_from"), F.create_map(F.concat(F.lit("i"), c("o_orderkey") % 3, F.lit(".json")), spec).alias("inputs"))
    asked = saved.where(c("schema") == snapshots.RUN_SCHEMA).select(c("o_orderkey").alias("request"), "schema", "inputs_from", "inputs")
    runs = snapshots.inherited_inputs(asked, saved.drop("o_orderkey")).select("*", F.array(F.lit("inputs")).alias("keys"), F.lit("b").alias("bundle_id"), F.lit("b").alias("wanted_id"), F.sha1(F.lit("s")).alias("source_ref"), F.lit(60).alias("timeout_seconds"), F.lit(None).cast("string").alias("config_json"))
    judged = contracts.run_request_errors(runs)
    listed = F.array_join(F.transform(F.map_entries("inputs"), lambda e: F.concat(e.key, F.lit("="), e.value.path)), ",")
    return judged.select(c("request").alias("o_orderkey"), "error", F.when(c("error").isNull(), listed).alias("inputs"))


@query("""
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id, html FROM pages)
SELECT host, CASE WHEN max((octet_length(encode(html)) > 4000)::INT) = 1 THEN 'wheelhouse contains a non-wheel entry' END AS error, CASE WHEN max((octet_length(encode(html)) > 4000)::INT) = 0 THEN count(*) END AS wheel_count,
       CASE WHEN max((octet_length(encode(html)) > 4000)::INT) = 0 THEN sum(octet_length(encode(html)))::BIGINT END AS wheel_bytes FROM h GROUP BY host UNION ALL SELECT 'nation-' || n_nationkey, 'wheelhouse is empty', NULL, NULL FROM nation""")
def wheel_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as folders of wheels, long pages being something else; nations as empty folders."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.concat("page_id", F.when(F.octet_length("html") > 4000, ".zip").otherwise(".whl")).alias("name"), F.lit(True).alias("regular"), F.encode("html", "utf-8").alias("content"))
    folders = files.select("host").distinct().union(table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey")))
    return identity.wheel_rows(folders, files, "host").select("host", "error", "wheel_count", "wheel_bytes")


@query("""
WITH c AS (SELECT c_custkey, 'bt-' || c_custkey AS id, sha1(c_custkey::VARCHAR) AS ref, c_nationkey AS n, c_acctbal AS b FROM customer)
SELECT c_custkey, CASE WHEN n = 1 THEN 'missing_repository_object' WHEN n = 2 THEN 'materialized_manifest_identity_mismatch' WHEN b < 0 THEN 'source_origin_unresolved' WHEN n = 3 THEN NULL WHEN n % 2 = 0 AND b > 5000 THEN 'source_origin_identity_mismatch' END AS error,
       CASE WHEN n NOT IN (1, 2) AND b >= 0 THEN CASE WHEN n = 3 THEN ref WHEN NOT (n % 2 = 0 AND b > 5000) THEN sha1('o' || c_custkey) END END AS origin FROM c""")
def source_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests whose sources were written by other commits, or the same ones."""
    c, n = F.col, F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", n, "c_acctbal", F.concat(F.lit("bt-"), "c_custkey").alias("bundle_id"), F.sha1("c_name").alias("bundle_blob"), F.sha1(c("c_custkey").cast("string")).alias("source_ref"), F.sha1(F.concat(F.lit("o"), "c_custkey")).alias("before"))
    here = rows.where(n != 1).select("source_ref", "bundle_id", F.when(n == 2, "x").otherwise(c("bundle_blob")).alias("bundle_blob"), F.sha2("bundle_id", 256).alias("digest"))
    there = rows.select(c("before").alias("source_ref"), "bundle_id", "bundle_blob", F.when((n % 2 == 0) & (c("c_acctbal") > 5000), "other").otherwise(F.sha2("bundle_id", 256)).alias("digest"))
    history = rows.where(c("c_acctbal") >= 0).select("source_ref", "bundle_id", F.when(n == 3, c("source_ref")).otherwise(c("before")).alias("origin"))
    return contracts.source_origins(rows.select("c_custkey", "bundle_id", "bundle_blob", "source_ref"), here.union(there), history).select("c_custkey", "error", "origin")