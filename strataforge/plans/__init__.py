"""Registered queries of the job-data operators, with their SQL.

Each runs an operator on a table that has its shape; the SQL says the same to DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge import functions as fn
from strataforge.operators import contracts, geometry, identity, lifecycle, progress, results, snapshots, structures
from strataforge.plans import deliveries, runs  # noqa: F401  registers their queries
from strataforge.plans.registry import QUERIES, SQL  # noqa: F401
from strataforge.plans.registry import query as _query
from strataforge.plans.registry import table as _table

_DET = "a[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (a[4] * a[9] - a[6] * a[7]) + a[3] * (a[4] * a[8] - a[5] * a[7])"


@_query(f"""
WITH e AS (SELECT vec_id, label + 1 AS n, CAST(embedding[1:9] AS DOUBLE[]) AS a FROM embeddings),
     v AS (SELECT vec_id, n, abs({_DET}) AS v FROM e)
SELECT vec_id, CASE WHEN v > 0 AND n >= 1 THEN v END AS volume_angstrom3, CASE WHEN v > 0 AND n >= 1 THEN v / n END AS volume_per_atom_angstrom3,
       CASE WHEN NOT v > 0 THEN 'cell must have a finite positive volume' WHEN n < 1 THEN 'atom_count must be a positive integer' END AS error
FROM v""")
def cell_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nine components as a lattice of three vectors, label + 1 as its atoms."""
    x = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    cells = _table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.slice(x, 1, 3), F.slice(x, 4, 3), F.slice(x, 7, 3)).alias("lattice"), (F.col("label") + 1).alias("atom_count"))
    return geometry.cell_geometry(cells).select("vec_id", "volume_angstrom3", "volume_per_atom_angstrom3", "error")


@_query("SELECT doc_id, sha256(text) AS sha256, left(sha256(text), 12) AS suffix, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", fn.content_sha256(text).alias("sha256"), fn.short_digest(text).alias("suffix"), F.octet_length(text).cast("long").alias("n_bytes"))


@_query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob FROM documents")
def blob_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", fn.blob_id(F.col("text")).alias("blob"))


@_query("""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(source, '[a-z0-9]')) AS element FROM documents)
SELECT doc_id, element, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS natoms FROM c GROUP BY doc_id, element""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source names as structures: their characters are the elements."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all("source", F.lit("([a-z0-9])"), 1).alias("species"), F.col("doc_id").alias("line"))
    return structures.structure_index(rows).select(F.col("id").alias("doc_id"), F.explode("composition").alias("element", "n"), "natoms")


@_query("SELECT event_id, json_valid(props) AS valid, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return _table(spark, sf_dir, "events").select("event_id", fn.strict_json(props).alias("valid"), (fn.json_kind(F.try_parse_json(props)) == "object").alias("is_object"))


def _micros() -> Column:
    """Microseconds of ts since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")


def _logs(spark: SparkSession, sf_dir: str, elapsed: Column | None = None) -> DataFrame:
    """Events of a user as a progress log: the value is the item's time, the event's number its place."""
    elapsed = _micros().cast("double") if elapsed is None else elapsed
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.lit(True).alias("terminated"), F.col("event_id").alias("processed"), F.lit(None).cast("long").alias("total"),
        elapsed.alias("elapsed_seconds"), F.col("event_id").cast("string").alias("last_id"), F.col("value").alias("item_seconds"), F.col("event_type").alias("phase"),
        F.when(~fn.finite_nonnegative(F.col("value")), "invalid_item_seconds").alias("error"),
    )


_LOG_SQL = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS el, value, event_type, lag(event_id) OVER w AS p_id, lag(epoch_us(ts)::DOUBLE) OVER w AS p_el
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
     r AS (SELECT *, CASE WHEN value IS NULL OR NOT isfinite(value) OR value < 0 THEN 'invalid_item_seconds' WHEN el < p_el THEN 'nonmonotonic_progress' END AS error FROM e),
     b AS (SELECT user_id, min(event_id) FILTER (error IS NOT NULL) AS bad FROM r GROUP BY user_id),
     v AS (SELECT r.* FROM r JOIN b USING (user_id) WHERE bad IS NULL OR event_id < bad),
     a AS (SELECT user_id, count(*) AS records, median(value) AS med, max(value) AS slow, arg_max(event_id, row(value, -event_id)) AS slow_id, max(event_id) AS last_id, arg_max(el, event_id) AS last_el, arg_max(event_type, event_id) AS phase FROM v GROUP BY user_id)
"""


@_query(_LOG_SQL + """
SELECT b.user_id, CASE WHEN bad IS NULL THEN 'valid' ELSE 'invalid' END AS status, r.error AS reason, coalesce(records, 0) AS records, bad AS line,
       CASE WHEN bad IS NULL THEN med END AS median_item_seconds, CASE WHEN bad IS NULL THEN slow END AS slowest_item_seconds,
       CASE WHEN bad IS NULL THEN slow_id::VARCHAR END AS slowest_id, CASE WHEN bad IS NULL THEN a.phase END AS phase
FROM b LEFT JOIN a USING (user_id) LEFT JOIN r ON r.user_id = b.user_id AND r.event_id = b.bad""")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.progress_summary(progress.monotony_errors(_logs(spark, sf_dir)))
    return out.select(F.col("file").alias("user_id"), "status", "reason", "records", "line", "median_item_seconds", "slowest_item_seconds", "slowest_id", "phase")


#: The same logs with the value as the elapsed time, which falls again and again.
_FALLING_SQL = _LOG_SQL.replace("epoch_us(ts)::DOUBLE", "value")


@_query(_FALLING_SQL + "SELECT user_id, event_id, error FROM r WHERE error IS NOT NULL")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.monotony_errors(_logs(spark, sf_dir, F.col("value"))).where("error is not null").select(F.col("file").alias("user_id"), F.col("line").alias("event_id"), "error")


@_query(_FALLING_SQL + "SELECT b.user_id, r.error AS reason, coalesce(records, 0) AS records, bad AS line FROM b LEFT JOIN a USING (user_id) LEFT JOIN r ON r.user_id = b.user_id AND r.event_id = b.bad")
def progress_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each log is valid."""
    out = progress.progress_summary(progress.monotony_errors(_logs(spark, sf_dir, F.col("value"))))
    return out.select(F.col("file").alias("user_id"), "reason", "records", "line")


@_query("""
WITH s AS (SELECT user_id, count(*) AS records, median(value) AS med, max(value) AS last, user_id % 3 <> 0 AS timed_out, CASE WHEN user_id % 5 > 0 THEN max(value) + user_id % 700 END AS wall, CASE WHEN user_id % 2 = 0 THEN 300.0 + user_id END AS budget FROM events GROUP BY user_id),
     g AS (SELECT *, CASE WHEN wall IS NOT NULL AND isfinite(wall) AND wall >= 0 THEN greatest(0.0, wall - last) END AS gap FROM s),
     t AS (SELECT *, CASE WHEN gap IS NOT NULL AND timed_out THEN greatest(CASE WHEN budget > 0 THEN least(60.0, greatest(1.0, 0.10::DOUBLE * budget)) ELSE 60.0 END, 5.0 * med) END AS threshold FROM g)
SELECT user_id, gap::DOUBLE AS seconds_since_last_progress, threshold::DOUBLE AS long_gap_threshold_seconds,
       CASE WHEN NOT timed_out THEN NULL WHEN gap IS NULL THEN 'timeout_progress_present_wall_unknown' WHEN gap >= threshold THEN 'timeout_long_gap_since_progress' ELSE 'timeout_recent_progress' END AS timeout_pattern
FROM t""")
def timeout_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's largest value as the last progress; wall time and budget follow from the user's number."""
    u = F.col("user_id")
    runs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("records"), F.median("value").alias("median_item_seconds"), F.max("value").alias("reported_elapsed_seconds"))
    runs = runs.withColumns({"timed_out": u % 3 != 0, "wall_seconds": F.when(u % 5 > 0, F.col("reported_elapsed_seconds") + u % 700), "timeout_budget_seconds": F.when(u % 2 == 0, F.lit(300.0) + u)})
    return progress.timeout_pattern(runs).select("user_id", "seconds_since_last_progress", "long_gap_threshold_seconds", "timeout_pattern")


@_query("""
WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, CASE WHEN trim(props) = '' THEN 'blank_line' WHEN NOT json_valid(props) THEN 'invalid_json' WHEN json_type(props) <> 'OBJECT' THEN 'non_object_row' END AS error FROM events),
     f AS (SELECT user_id, count(*) AS n, min(line) FILTER (error IS NOT NULL) AS bad FROM l GROUP BY user_id),
     x AS (SELECT f.*, CASE WHEN f.user_id % 4 = 0 THEN n + 1 WHEN f.user_id % 4 = 1 THEN n END AS expected, l.error FROM f LEFT JOIN l ON l.user_id = f.user_id AND l.line = f.bad)
SELECT user_id, CASE WHEN bad IS NOT NULL OR coalesce(expected <> coalesce(bad - 1, n), false) THEN 'invalid' ELSE 'valid' END AS status,
       CASE WHEN bad IS NOT NULL THEN error WHEN expected <> n THEN 'row_count_mismatch' END AS reason, coalesce(bad - 1, n) AS records, bad AS line
FROM x""")
def result_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's props as the lines of a result log; every fourth user expects a row too many."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", F.col("props").alias("raw"))
    numbered = events.selectExpr("file", "raw", "row_number() over (partition by file order by event_id) as line").withColumn("line", F.col("line").cast("long"))
    files = events.groupBy("file").agg(F.count("*").alias("size")).withColumn("expected_rows", F.when(F.col("file") % 4 == 0, F.col("size") + 1).when(F.col("file") % 4 == 1, F.col("size")))
    return results.result_verdicts(numbered, files).withColumnRenamed("file", "user_id")


@_query("""
WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(lang) END AS h FROM documents JOIN labels USING (doc_id) UNION ALL SELECT -1 - page_id, sha256(html) FROM pages),
     g AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT -1000000000 - item_id FROM benchmark), k AS (SELECT doc_id FROM b UNION SELECT doc_id FROM c UNION SELECT doc_id FROM g),
     s AS (SELECT k.doc_id, b.h AS old, c.h AS new, CASE WHEN g.doc_id IS NOT NULL AND b.doc_id IS NULL THEN 'missing_delete' WHEN g.doc_id IS NOT NULL THEN 'deleted' WHEN c.h = b.h THEN 'unchanged' WHEN c.h IS NOT NULL THEN 'changed' ELSE 'inherited' END AS status
           FROM k LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, status, CASE WHEN status IN ('unchanged', 'changed') THEN new WHEN status = 'inherited' THEN old END AS h FROM s""")
def overlay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a base; the labelled ones and all pages as changes, the toxic ones and benchmark items as deletions."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    base = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    edited = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2("lang", 256)).alias("h"))
    added = _table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.sha2("html", 256).alias("h"))
    gone = labels.where("toxic = 1").select("doc_id").union(_table(spark, sf_dir, "benchmark").select((-1_000_000_000 - F.col("item_id")).alias("doc_id")))
    return snapshots.overlay(base, edited.union(added), gone, "doc_id", "h")


@_query("SELECT DISTINCT o_custkey + 10 AS c_custkey FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)")
def missing_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k"))
    return structures.missing_keys(_table(spark, sf_dir, "customer"), keys, "c_custkey")


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR n_chars IN (SELECT p_size * 100 FROM part)")
def select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id (the toxic ones) or by line (their length, against sizes of parts)."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("source_line"), "lang")
    ids = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    lines = _table(spark, sf_dir, "part").select((F.col("p_size") * 100).cast("long").alias("line"))
    return structures.select_records(rows, ids, lines).select(F.col("id").alias("doc_id"), "lang")


@_query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _table(spark, sf_dir, "events").select("user_id", _micros().alias("run"), F.col("event_id").alias("attempt"), "event_type", "value")
    return lifecycle.latest_attempts(attempts, ["user_id"], ["run", "attempt"]).select("user_id", F.col("attempt").alias("event_id"), "event_type", "value")


@_query("""
WITH m AS (SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY conv_id, role)
SELECT m.conv_id, m.role, m.turn, sha256(c.text) AS content FROM m JOIN conversations c USING (conv_id, role, turn)""")
def input_chain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn inherits from the turn before; of a role's texts the newest wins, seen from the last turn."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("node"), "conv_id", "turn", "role", F.sha2("text", 256).alias("content"))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    linked = turns.join(first, "conv_id").withColumn("parent", F.when(F.col("turn") > F.col("first"), F.concat_ws("-", "conv_id", F.col("turn") - 1)))
    chain = snapshots.request_chain(linked, "node", "parent", linked.where("turn = last").select("node"))
    merged = snapshots.merge_layers(chain, linked, "node", "role", "content")
    part = F.split("node", "-")
    return merged.select(part[0].cast("long").alias("conv_id"), "role", part[1].cast("long").alias("turn"), "content")


@_query("""
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id, html FROM pages)
SELECT host, page_id::VARCHAR AS name, sha256(html) AS digest, count(*) OVER w AS n_files, sum(octet_length(encode(html))) OVER w::BIGINT AS total_bytes FROM h WINDOW w AS (PARTITION BY host)""")
def manifest_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a host as its files."""
    files = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.col("page_id").cast("string").alias("name"), "html")
    return identity.manifest_rows(files, "host", "name", "html")


@_query("""
WITH r AS (SELECT l_orderkey, l_linenumber, 'Task-' || l_partkey || CASE WHEN l_partkey % 50 = 0 THEN ' x' ELSE '' END AS id, CASE l_linenumber % 4 WHEN 0 THEN 'descriptor' WHEN 1 THEN 'ml' WHEN 2 THEN 'infrastructure' ELSE 'gpu' END AS lane, CAST(l_quantity AS INT) - 5 AS slot FROM lineitem),
     b AS (SELECT *, CASE lane WHEN 'descriptor' THEN 20 WHEN 'ml' THEN 8 WHEN 'infrastructure' THEN 2 END AS bound FROM r),
     e AS (SELECT *, CASE WHEN contains(id, ' ') THEN 'invalid_trigger_id' WHEN bound IS NULL THEN 'invalid_execution_lane' WHEN slot < 0 OR slot >= bound THEN 'execution_slot_out_of_range' END AS error FROM b)
SELECT l_orderkey, l_linenumber, error, CASE WHEN error IS NULL THEN 'scoped-private-trigger/3' END AS schema,
       CASE WHEN error IS NULL THEN 'transport/task_requests/' || id || '.json' END AS task_path, CASE WHEN error IS NULL THEN printf('private_job/slots/%s-%02d.json', lane, slot) END AS resolved_path
FROM e""")
def contract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as slot requests."""
    n, p = F.col("l_linenumber") % 4, F.col("l_partkey")
    requests = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(*map(F.lit, ("version", "id", "lane", "slot"))).alias("keys"), F.lit(3).alias("version"), F.concat(F.lit("Task-"), p.cast("string"), F.when(p % 50 == 0, " x").otherwise("")).alias("id"),
        F.when(n == 0, "descriptor").when(n == 1, "ml").when(n == 2, "infrastructure").otherwise("gpu").alias("lane"), (F.col("l_quantity").cast("int") - 5).alias("slot"), F.lit(None).cast("string").alias("request_path"),
    )
    return contracts.resolve_requests(requests).select("l_orderkey", "l_linenumber", "error", "schema", "task_path", "resolved_path")


@_query("SELECT replace(lower(p_brand), '_', '-') AS normalized, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.duplicate_names(_table(spark, sf_dir, "part"), "p_brand")


@_query("""
WITH w AS (SELECT DISTINCT o_custkey + 10 AS k, sha256((o_custkey + 10)::VARCHAR) AS h FROM orders), a AS (SELECT c_custkey AS k, sha256(CASE WHEN c_nationkey = 3 THEN c_name ELSE c_custkey::VARCHAR END) AS h FROM customer)
SELECT coalesce(w.k, a.k) AS k, CASE WHEN a.h IS NULL THEN 'missing' WHEN w.h IS NULL THEN 'undeclared' ELSE 'hash_mismatch' END AS problem FROM w FULL JOIN a ON w.k = a.k WHERE a.h IS NULL OR w.h IS NULL OR a.h <> w.h""")
def identity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that all orders declare, ten numbers on, against all those on record."""
    number = F.sha2(F.col("k").cast("string"), 256)
    want = _table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k")).distinct().withColumn("h", number)
    have = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.sha2(F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")), 256).alias("h"))
    return identity.identity_mismatches(want, have, "k", "h")


@_query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', CASE page_id % 4 WHEN 0 THEN 'inputs/' WHEN 1 THEN '/' WHEN 2 THEN 'elements/../' ELSE 'other/' END) AS path FROM pages)
SELECT page_id, path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\\') AND NOT list_contains(string_split(path, '/'), '..') AS safe, starts_with(path, 'inputs/') OR starts_with(path, 'elements/') AS allowed FROM p""")
def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as paths of several kinds."""
    n = F.col("page_id") % 4
    prefix = F.when(n == 0, "inputs/").when(n == 1, "/").when(n == 2, "elements/../").otherwise("other/")
    paths = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", F.lit("^[a-z]+://"), prefix).alias("path"))
    return paths.select("page_id", fn.safe_path(F.col("path")).alias("safe"), fn.starts_with_any(F.col("path"), contracts.INPUT_PREFIXES).alias("allowed"))


@_query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'opened' ELSE event_type END AS action, event_id % 11 = 0 AS pr, 'u' || user_id AS actor, 'u' || CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS owner,
           'bundle-task:' || CASE WHEN event_id % 5 = 0 THEN 'x-' ELSE 'bt-' END || event_id AS title, event_id % 3 = 0 AS odd FROM events)
SELECT event_id, CASE WHEN action <> 'opened' THEN 'unsupported_event' WHEN pr THEN 'invalid_trigger' WHEN actor <> owner THEN 'owner_required' WHEN NOT starts_with(title, 'bundle-task:bt-') THEN 'invalid_trigger' WHEN odd THEN 'unexpected_public_body' ELSE 'authorized' END AS reason FROM t""")
def trigger_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as triggers of several kinds."""
    n, user = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    owner = F.concat(F.lit("u"), F.when(n % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string"))
    name = F.concat(F.when(n % 5 == 0, "x-").otherwise("bt-"), n.cast("string"))
    events = _table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 2 == 0, "opened").otherwise(F.col("event_type")).alias("action"), (n % 11 == 0).alias("is_pull_request"), user.alias("actor"), owner.alias("owner"), F.lit(None).cast("string").alias("triggering_actor"), user.alias("author"),
        F.concat(F.lit("bundle-task:"), name).alias("title"), F.when(n % 3 == 0, "hello").otherwise(F.concat(F.lit("id="), name, F.lit("\n schema=private-bundle-trigger/2\n"))).alias("body"),
    )
    return contracts.trigger_decisions(events).select("event_id", "reason")


@_query("""
SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS done FROM orders""")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; unknown flags are null."""
    k = F.col("o_orderkey")
    done = lifecycle.completed(
        F.lit("materialized"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1), F.when(k % 2 == 0, F.lit(False)), (k % 7 == 0), F.floor(F.greatest(F.col("o_totalprice") - 1000, F.lit(0)) + 0.999999), F.lit("valid"), F.when(k % 5 == 0, 1), F.lit(0)
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", done.alias("done"))


@_query("""
WITH a AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS nat FROM customer), b AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'AUTOMOBILE' END AS seg, s_nationkey AS nat FROM supplier)
SELECT c_custkey, s_suppkey FROM a JOIN b ON a.nat = b.nat AND a.seg IS NOT DISTINCT FROM b.seg""")
def receipt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that agree in nation and segment, nulls included."""
    a = _table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.col("c_nationkey").alias("nat"))
    n = F.col("s_suppkey") % 3
    b = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n == 0, "MACHINERY").when(n == 1, "AUTOMOBILE").alias("seg"), F.col("s_nationkey").alias("nat"))
    return lifecycle.identity_pairs(a, b, ["seg", "nat"]).select("c_custkey", "s_suppkey")


@_query("""
WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'transport' ELSE 'other' END AS kind, 395 + CAST(l_quantity AS INT) * 3 AS code FROM lineitem)
SELECT CASE kind WHEN 'transport' THEN 'transport_error' WHEN 'other' THEN 'validation_or_materialization_error' ELSE CASE WHEN code = 404 THEN 'missing_repository_object' WHEN code IN (401, 403) THEN 'authorization_or_rate_limit' WHEN code = 429 OR code >= 500 THEN 'remote_service_error' ELSE 'remote_request_error' END END AS category, count(*) AS n FROM e GROUP BY 1""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    kind = F.when(n == 0, "http").when(n == 1, "transport").otherwise("other")
    return _table(spark, sf_dir, "lineitem").groupBy(contracts.error_category(kind, F.col("l_quantity").cast("int") * 3 + 395).alias("category")).agg(F.count("*").alias("n"))


@_query("""
SELECT d.doc_id::VARCHAR AS path, CASE WHEN toxic = 0 THEN sha1(l.doc_id::VARCHAR) END AS sha, CASE WHEN toxic = 1 THEN 'existing_path_not_blob' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)""")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a tree in which the toxic ones are folders."""
    paths = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    tree = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("toxic") == 1, "tree").otherwise("blob").alias("type"), F.sha1(F.col("doc_id").cast("string")).alias("sha"))
    return snapshots.lookup_paths(paths, tree)


@_query("""
SELECT doc_id AS k, lang AS v, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 0 AND lang <> 'en' THEN 'conflict' ELSE 'same' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)""")
def create_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages to be put where the labelled documents' rows exist, poor ones with another language."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    held = docs.join(_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "k"), "k").select("k", F.when(F.col("quality") == 0, "en").otherwise(F.col("v")).alias("v"))
    return lifecycle.create_only(held, docs, "k", "v")


@_query("""
SELECT c_custkey, sha256('{"name":"' || c_name || '","nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map's digest, whatever the order of its keys."""
    entries = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), "c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", fn.canonical_digest(entries).alias("digest"))


@_query("""
WITH s AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a, list(DISTINCT left(o_orderpriority, 1)) AS b, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, NOT list_has_any(a, ['P']) AS disjoint_from_p, len(a) = 2 AND list_has_all(a, ['F', 'O']) AS exactly_f_o, len(b) = n AS no_repeats FROM s""")
def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order statuses and priorities as sets."""
    b = F.substring("o_orderpriority", 1, 1)
    per = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), (F.count_distinct(b) == F.count(b)).alias("no_repeats"))
    want = lambda *x: F.array(*map(F.lit, x))
    return per.select("o_custkey", identity.disjoint(F.col("a"), want("P")).alias("disjoint_from_p"), identity.set_equal(F.col("a"), want("F", "O")).alias("exactly_f_o"), "no_repeats")


@_query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'run.py' ELSE 'run_task.py' END AS file, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN sha256(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END) END AS hash,
           CASE p_partkey % 5 WHEN 0 THEN 'inputs/a' WHEN 1 THEN '../a' WHEN 2 THEN 'else/a' ELSE 'elements/a' END AS path, CASE WHEN p_partkey % 7 = 0 THEN 'zz' ELSE sha1(p_name) END AS ref, p_size * 40 AS seconds FROM part)
SELECT p_partkey, CASE WHEN file <> 'run_task.py' THEN 'invalid_source_manifest' WHEN hash <> sha256(text) THEN 'source_hash_mismatch' WHEN path = '../a' THEN 'invalid_path' WHEN path = 'else/a' THEN 'input_path_not_allowed'
       WHEN ref = 'zz' THEN 'input_identity_invalid' WHEN seconds NOT BETWEEN 30 AND 1800 THEN 'invalid_timeout' END AS error FROM b""")
def bundle_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bundles of one source and one input, many of them wrong in some way."""
    p = F.col("p_partkey")
    file = F.when(F.col("p_size") % 10 == 0, "run.py").otherwise("run_task.py")
    path = F.when(p % 5 == 0, "inputs/a").when(p % 5 == 1, "../a").when(p % 5 == 2, "else/a").otherwise("elements/a")
    ref = F.when(p % 7 == 0, "zz").otherwise(F.sha1("p_name"))
    bundles = _table(spark, sf_dir, "part").select(
        "p_partkey", F.create_map(file, F.col("p_name")).alias("files"), F.when(p % 3 == 0, F.create_map(file, F.sha2(F.when(p % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")), 256))).alias("hashes"),
        F.create_map(F.lit("data.json"), F.struct(path.alias("path"), ref.alias("ref"), F.sha1("p_brand").alias("blob"))).alias("inputs"), (F.col("p_size") * 40).alias("timeout_seconds"),
    )
    return contracts.bundle_errors(bundles).select("p_partkey", "error")
