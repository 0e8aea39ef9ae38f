"""Snapshots of file trees: lookups, overlays of changes, chains of requests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions import blob_id_of_bytes, fullmatch


# Fixed values of the formats: what may stand in a chain of requests.
RUN_SCHEMA = "private-run-request/1"
REQUEST_SCHEMAS = [RUN_SCHEMA, "private-task-bundle/2", "private-task-bundle/3", "private-task-bundle/4"]


def lookup_paths(paths: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, sha, error) of requested paths in a snapshot (path, type, sha); sha is null where absent."""
    held = snapshot.select("path", "type", F.col("sha").alias("_sha"))
    wrong = F.col("type").isNotNull() & ((F.col("type") != "blob") | F.col("_sha").isNull())
    return paths.join(held, "path", "left").select("path", F.when(~wrong, F.col("_sha")).alias("sha"), F.when(wrong, "existing_path_not_blob").alias("error"))


def below(snapshot: DataFrame, folder: str) -> DataFrame:
    """The entries of a snapshot directly in ``folder``."""
    prefix = folder.rstrip("/") + "/"
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    return snapshot.where(F.col("path").startswith(prefix) & ~rest.contains("/"))


def folder_entries(requests: DataFrame, entries: DataFrame, truncated: DataFrame) -> DataFrame:
    """(snapshot, folder, path, type, sha, error) of what lies directly in requested folders (snapshot, folder).

    A snapshot whose listing is truncated (named in ``truncated``) is an error, and so is a folder
    that is something else; a folder that isn't there has one row without a path.
    """
    parent = F.regexp_extract("path", r"\A(?s)(.*)/[^/]*\z", 1)
    inside = entries.select("snapshot", parent.alias("folder"), "path", "type", "sha")
    itself = entries.select("snapshot", F.col("path").alias("folder"), F.col("type").alias("_type"))
    cut = truncated.select("snapshot").distinct().withColumn("_cut", F.lit(True))
    asked = requests.join(cut, "snapshot", "left").join(itself, ["snapshot", "folder"], "left")
    error = F.when(F.col("_cut"), "incomplete_git_tree").when(F.col("_type") != "tree", "expected_result_directory")
    found = asked.withColumn("error", error).join(inside, ["snapshot", "folder"], "left")
    good = lambda name: F.when(F.col("error").isNull(), F.col(name)).alias(name)
    return found.select("snapshot", "folder", good("path"), good("type"), good("sha"), "error").distinct()


def overlay(base: DataFrame, changes: DataFrame, deletes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status, value) of a base with changes and deletions on top, one full outer join each.

    Statuses: changed, unchanged (a change to equal content), inherited, deleted, missing_delete (an
    error: nothing to delete). Deleted keys have no value.
    """
    both = base.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_base")).join(changes.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_changes")), key, "full_outer")
    gone = deletes.select(F.col(deletes.columns[0]).alias(key)).distinct().withColumn("_gone", F.lit(True))
    merged = both.join(gone, key, "full_outer")
    c = F.col
    status = (
        F.when(c("_gone") & c("_in_base").isNull(), "missing_delete").when(c("_gone"), "deleted")
        .when(c("_in_changes") & c("_in_base") & c("_old").eqNullSafe(c("_new")), "unchanged").when(c("_in_changes"), "changed").otherwise("inherited")
    )
    return merged.select(key, status.alias("status"), F.when(status.isin("unchanged", "changed"), c("_new")).when(status == "inherited", c("_old")).alias(value))


def overlay_verdicts(overlaid: DataFrame, by: str, key: str) -> DataFrame:
    """(group, error) of ``overlay``'s rows of many successors: a missing deletion, no entry point left, or no effect."""
    final = F.col("status").isin("changed", "unchanged", "inherited")
    per = overlaid.groupBy(by).agg(
        F.max((F.col("status") == "missing_delete").cast("int")).alias("m"), F.max((final & (F.col(key) == "run_task.py")).cast("int")).alias("r"), F.max(F.col("status").isin("changed", "deleted").cast("int")).alias("e")
    )
    return per.select(by, F.when(F.col("m") == 1, "successor_delete_missing_file").when(F.col("r") == 0, "invalid_final_source_manifest").when(F.col("e") == 0, "successor_no_effect").alias("error"))


def pinned_reads(requests: DataFrame, snapshot: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Requests (ref, path, expected_blob or null, size_limit or null) with content and blob from a snapshot
    (ref, path, type, sha, size, content in bytes), or the first assertion that fails; content must hash to its blob.

    Content that a snapshot holds only by its blob (null) comes from ``blobs`` (sha, content), where given.
    """
    held = snapshot.select("ref", "path", F.col("type").alias("_type"), F.col("sha").alias("_sha"), F.col("size").alias("_size"), F.col("content").alias("_content"))
    c = F.col
    met = requests.join(held, ["ref", "path"], "left")
    if blobs is not None:
        met = met.join(blobs.select(c("sha").alias("_sha"), c("content").alias("_body")), "_sha", "left").withColumn("_content", F.coalesce("_content", "_body"))
    error = (
        F.when(c("_type").isNull(), "missing_repository_object").when(c("_type") != "blob", "expected_file").when(~fullmatch(c("_sha"), r"[0-9a-f]{40}"), "invalid_blob_identity")
        .when(c("expected_blob").isNotNull() & (c("expected_blob") != c("_sha")), "pinned_file_identity_mismatch").when(F.coalesce(c("_size") > c("size_limit"), F.lit(False)), "file_too_large")
        .when(c("_content").isNull(), "missing_repository_object").when(blob_id_of_bytes(c("_content")) != c("_sha"), "blob_identity_mismatch")
        .when(F.coalesce(F.octet_length("_content") > c("size_limit"), F.lit(False)), "file_too_large")
    )
    good = lambda name: F.when(c("error").isNull(), c(name))
    return met.withColumn("error", error).select(*requests.columns, "error", good("_sha").alias("blob"), good("_content").alias("content"))


def request_chain(requests: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """(root, node, depth, error) of every request that a root reaches through its parents.

    Steps double: after k rounds every request knows its ancestor 2**k steps up, so a chain of n
    requests takes log n rounds, each a checkpointed join. A request that stands in its own chain
    ends it with ``cyclic_chain``, a parent that isn't there with ``missing_parent``.
    """
    spark = requests.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chain-"))  # a local session that names none
    nodes = requests.select(F.col(node).alias("parent"), F.lit(True).alias("known")).distinct()
    edges = requests.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("parent is not null").join(nodes, "parent", "left").checkpoint()
    start = F.col(roots.columns[0])
    # what each root has reached: all 2**k of it step 2**k further at once
    found = roots.select(start.alias("root"), start.alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("closed"))
    jumps = edges.where("known").select("node", F.col("parent").alias("to"))
    ends = edges.where("known is null").select("node", F.col("parent").alias("to"))
    span = 1
    while True:
        ahead = found.where(F.col("error").isNull() & ~F.coalesce("closed", F.lit(False))).join(jumps, "node").select("root", F.col("to").alias("node"), (F.col("depth") + span).alias("depth")).checkpoint()
        if ahead.isEmpty():
            break
        reached = found.select("root", "node", "depth").union(ahead)
        # a chain is closed where it comes back to a request; what lies beyond is dropped
        again = reached.withColumn("first", F.min("depth").over(Window.partitionBy("root", "node"))).where("depth > first").groupBy("root").agg(F.min("depth").alias("back"))
        open_ = reached.join(again, "root", "left").where(F.col("back").isNull() | (F.col("depth") <= F.col("back")))
        found = open_.select("root", "node", "depth", F.when(F.col("depth") == F.col("back"), "cyclic_chain").alias("error"), F.col("back").isNotNull().alias("closed")).checkpoint()
        jumps = jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")).checkpoint()
        span *= 2
    chain = found.drop("closed")
    lost = chain.where("error is null").join(ends, "node").select("root", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit("missing_parent").alias("error"))
    return chain.union(lost)


def merge_layers(chain: DataFrame, entries: DataFrame, node: str, key: str, value: str) -> DataFrame:
    """(root, key, value, node): of a chain's layers of entries the newest (least deep) wins per key."""
    layers = chain.where("error is null").join(entries.select(F.col(node).alias("node"), key, value), "node")
    newest = F.min(F.struct("depth", F.col("node").alias("node"), F.col(value).alias("value"))).alias("n")
    return layers.groupBy("root", key).agg(newest).select("root", key, F.col("n.value").alias(value), F.col("n.node").alias(node))


def inherited_inputs(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """``requests`` (request, schema, inputs_from, inputs map) with the inputs they inherit and ``inputs_error``.

    A run request may name the blob of an earlier request in ``inputs_from``, whose inputs it takes over beneath its own, and so on through
    ``saved`` (blob, schema, inputs_from, inputs). What fails first along the chain counts: a name that is no blob, a chain that comes
    back, a blob that isn't there, a document that is no request.
    """
    c, own = F.col, lambda name: F.concat(F.lit("request:"), name)
    entry = "map<string,struct<path:string,ref:string,blob:string>>"
    node = lambda rows, name: rows.select(name.alias("node"), "schema", "inputs_from", c("inputs").cast(entry).alias("inputs"))
    every = node(requests, own(c("request").cast("string"))).union(node(saved, c("blob")))
    named = fullmatch(c("inputs_from"), r"[0-9a-f]{40}")
    follows = (c("schema") == RUN_SCHEMA) & c("inputs_from").isNotNull()
    linked = every.withColumn("parent", F.when(follows & named, c("inputs_from")))
    chain = request_chain(linked, "node", "parent", requests.select(own(c("request").cast("string")).alias("node")))
    facts = linked.select("node", F.when(~F.coalesce(c("schema").isin(*REQUEST_SCHEMAS), F.lit(False)) & ~c("node").startswith("request:"), "inputs_from_not_a_request").when(follows & ~named, "invalid_inputs_from").alias("fault"))
    told = chain.join(facts, "node", "left").withColumn("code", F.when(c("error") == "cyclic_chain", "cyclic_inputs_from").when(c("error") == "missing_parent", "missing_repository_object").otherwise(c("fault")))
    errors = told.where("code is not null").groupBy("root").agg(F.min(F.struct("depth", "code")).getField("code").alias("inputs_error"))
    entries = linked.where("inputs is not null").select("node", F.explode("inputs").alias("name", "spec"))
    merged = merge_layers(chain, entries, "node", "name", "spec").groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "spec")))).alias("_merged"))
    out = requests.join(errors, own(c("request").cast("string")) == c("root"), "left").drop("root").join(merged, own(c("request").cast("string")) == c("root"), "left").drop("root")
    return out.withColumn("inputs", F.coalesce("_merged", c("inputs").cast(entry))).drop("_merged")
