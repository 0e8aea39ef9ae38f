"""Contracts of requests and bundles as error columns: the first broken rule, in the rules' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions import blank, blob_id_of_bytes, decoded_base64, field, fullmatch, json_kind, safe_path, starts_with_any, strict_json, stripped
from strataforge.sources import SPLITS

# Fixed values of the formats.
TRIGGER_ID = r"[A-Za-z0-9][A-Za-z0-9_.\-]{0,95}"
BUNDLE_ID = r"bt-[A-Za-z0-9_.\-]{1,64}"
FILE_NAME = r"[A-Za-z0-9][A-Za-z0-9_.\-]{0,95}"
OBJECT_ID = r"[0-9a-f]{40}"
LANES = {"descriptor": 20, "ml": 8, "infrastructure": 2}
SLOT_PREFIX = "private_job/slots"
SINGLE_PATH = "private_job/request.json"
TASK_PREFIX = "transport/task_requests"
INPUT_PREFIXES = ["inputs/", "elements/", "transport/parallel-", "transport/reference/", "transport/executions/", "transport/bundle-executions/", "transport/recovered/", "transport/tasks/"]
SOURCE_MANIFEST = "BUNDLE_SOURCE.json"
ENTRY_POINT = "run_task.py"
SECONDS = (30, 1800)


def lane_slots(lane: Column) -> Column:
    """Slots of a lane, or null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANES.items() for x in pair)), lane)


def slot_path(lane: Column, slot: Column) -> Column:
    return F.format_string(SLOT_PREFIX + "/%s-%02d.json", lane, slot)


def slot_error(trigger_id: Column, lane: Column, slot: Column) -> Column:
    """What is wrong with a slot request's id, lane or slot, or null."""
    bound = lane_slots(lane)
    return F.when(~fullmatch(trigger_id, TRIGGER_ID), "invalid_trigger_id").when(bound.isNull(), "invalid_execution_lane").when(slot.isNull(), "invalid_execution_slot").when((slot < 0) | (slot >= bound), "execution_slot_out_of_range")


def resolve_requests(requests: DataFrame) -> DataFrame:
    """Requests (keys array, version, id, lane, slot, request_path or null) resolved by their exact key set.

    Version 1 has only an id, version 2 adds the version, version 3 a lane and a slot. Whatever
    breaks a rule has an ``error`` and no other result.
    """
    c = F.col
    keys = F.array_sort("keys")
    shape = lambda *names: keys == F.array(*(F.lit(n) for n in sorted(names)))
    one, two = shape("id"), shape("id", "version") & (c("version") == 2)
    three = shape("id", "lane", "slot", "version") & (c("version") == 3)
    kind = F.when(one, 1).when(F.coalesce(two, F.lit(False)), 2).when(F.coalesce(three, F.lit(False)), 3)
    rows = requests.withColumn("_kind", kind)
    path = F.when(c("_kind") == 3, slot_path(c("lane"), c("slot"))).otherwise(SINGLE_PATH)
    mismatch = c("request_path").isNotNull() & (c("request_path") != path)
    name = F.element_at(F.array(*map(F.lit, ("legacy_request_path_mismatch", "v2_request_path_mismatch", "slot_request_path_mismatch"))), c("_kind"))
    error = (
        F.when(c("_kind").isNull(), "unsupported_request_shape").when(~fullmatch(c("id"), TRIGGER_ID), "invalid_trigger_id")
        .when(c("_kind") == 3, F.coalesce(slot_error(c("id"), c("lane"), c("slot")), F.when(mismatch, name))).when(mismatch, name)
    )
    rows = rows.withColumn("error", error)
    good = lambda value: F.when(c("error").isNull(), value)
    task = F.when(c("_kind") == 1, "transport/active_task.json").otherwise(F.concat(F.lit(TASK_PREFIX + "/"), c("id"), F.lit(".json")))
    return rows.select(
        *requests.columns, "error", good(F.concat(F.lit("scoped-private-trigger/"), c("_kind").cast("string"))).alias("schema"), good(task).alias("task_path"), good(path).alias("resolved_path"),
        good(F.when(c("_kind") == 3, c("lane")).otherwise("descriptor")).alias("resolved_lane"), good(F.when(c("_kind") == 3, c("slot")).otherwise(0)).alias("resolved_slot"),
        good(c("_kind") > 1).alias("parallel_preparation_safe"), good(c("_kind") == 3).alias("parallel_execution_safe"),
    )


def trigger_decisions(events: DataFrame) -> DataFrame:
    """Events (action, is_pull_request, actor, owner, triggering_actor, author, title, body) with ok, bundle_id, reason."""
    c = F.col
    title = stripped(c("title"))
    bundle = F.when(fullmatch(title, "bundle-task:" + BUNDLE_ID), F.substring(title, len("bundle-task:") + 1, 200))
    lines = F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), SPLITS["unicode"]), stripped), lambda x: x != "")
    wanted = F.array_sort(F.array(F.lit("schema=private-bundle-trigger/2"), F.concat(F.lit("id="), bundle)))
    owned = (c("owner") != "") & (c("actor") == c("owner")) & (F.coalesce(F.nullif("triggering_actor", F.lit("")), c("actor")) == c("owner")) & c("author").eqNullSafe(c("owner"))
    reason = (
        F.when(~F.coalesce(c("action").isin("opened", "reopened"), F.lit(False)), "unsupported_event").when(F.coalesce("is_pull_request", F.lit(False)), "invalid_trigger")
        .when(~F.coalesce(owned, F.lit(False)), "owner_required").when(bundle.isNull(), "invalid_trigger").when((F.size(lines) > 0) & (F.array_sort(lines) != wanted), "unexpected_public_body").otherwise("authorized")
    )
    return events.withColumns({"reason": reason, "ok": reason == "authorized", "bundle_id": F.when(reason == "authorized", bundle).otherwise("")})


def input_error(name: Column, path: Column, ref: Column, blob: Column, reserved: Column | None = None) -> Column:
    """What is wrong with a pinned input, or null; ``reserved`` says whether its name is taken."""
    taken = F.coalesce(reserved, F.lit(False)) if reserved is not None else F.lit(False)
    return (
        F.when(~fullmatch(name, FILE_NAME) | taken, "invalid_input_entry").when(~safe_path(path), "invalid_path").when(~starts_with_any(path, INPUT_PREFIXES), "input_path_not_allowed")
        .when(~(fullmatch(ref, OBJECT_ID) & fullmatch(blob, OBJECT_ID)), "input_identity_invalid")
    )


def plain_source_name(name: Column) -> Column:
    return fullmatch(name, FILE_NAME) & (name != SOURCE_MANIFEST)


def source_error(name: Column, text: Column) -> Column:
    return F.when(~plain_source_name(name) | text.isNull(), "invalid_source_entry")


def _first(entries: Column, rule) -> Column:  # noqa: ANN001
    """The first error that ``rule`` finds, entry by entry."""
    return F.get(F.filter(F.transform(entries, rule), lambda e: e.isNotNull()), F.lit(0))


def bundle_errors(bundles: DataFrame) -> DataFrame:
    """Bundles (files, hashes maps; inputs map of (path, ref, blob); timeout_seconds) with the first broken rule.

    Declared hashes may be absent (null); where they are given they must cover the files exactly.
    Files, then inputs, are judged one after another.
    """
    c = F.col
    files, inputs = F.map_entries("files"), F.map_entries(F.coalesce("inputs", F.create_map().cast("map<string,struct<path:string,ref:string,blob:string>>")))
    names = F.map_keys("files")
    declared = c("hashes").isNotNull()
    covered = (F.size(F.array_except(names, F.map_keys("hashes"))) == 0) & (F.size(F.array_except(F.map_keys("hashes"), names)) == 0)
    wrong_hash = lambda e: F.when(declared & ~F.sha2(e.value, 256).eqNullSafe(F.try_element_at(c("hashes"), e.key)), "source_hash_mismatch")
    low, high = SECONDS
    error = (
        F.when(F.coalesce(F.size("files"), F.lit(0)) < 1, "invalid_source_files").when(~F.array_contains(names, ENTRY_POINT), "invalid_source_manifest").when(declared & ~covered, "invalid_source_manifest")
        .otherwise(F.coalesce(
            _first(files, lambda e: F.coalesce(source_error(e.key, e.value), wrong_hash(e))),
            _first(inputs, lambda e: input_error(e.key, e.value.path, e.value.ref, e.value.blob, F.array_contains(names, e.key))),
            F.when(~F.coalesce(c("timeout_seconds").between(low, high), F.lit(True)), "invalid_timeout"),
        ))
    )
    return bundles.withColumn("error", error)


# Fixed values of the formats: bundles with declared hashes, with text alone, and successors of an earlier source.
BUNDLE_SCHEMAS = ["private-task-bundle/2", "private-task-bundle/3", "private-task-bundle/4"]


def bundle_verdicts(bundles: DataFrame) -> DataFrame:
    """Bundles as JSON texts (raw, bundle_id) with ``schema`` and the first broken rule, whole documents judged.

    A successor (the last schema) names an earlier source by its commit and lists changed and
    deleted files; the others list all files, with their hashes or, in the second schema, without.
    Kinds are lexical: ``30.0`` is no time-out. JSON is strict here, so NaN makes a text invalid.
    """
    c, text_of = F.col, lambda value: F.when(json_kind(value) == "string", F.try_variant_get(value, "$", "string"))
    names = ["schema", "bundle_id", "base_source_ref", "files", "changed_files", "sha256", "inputs", "delete_files", "timeout_seconds"]
    # typed once, step by step: the rules below read these columns and never the document
    found = bundles.withColumn("_v", F.try_parse_json("raw")).withColumn("_root", json_kind(c("_v")))
    found = found.withColumns({f"_f_{n}": field(c("_v"), n) for n in names}).withColumns({f"_k_{n}": json_kind(c(f"_f_{n}")) for n in names})
    members = lambda n: F.coalesce(F.map_entries(F.try_variant_get(c(f"_f_{n}"), "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    typed = lambda e: F.struct(e.key.alias("key"), text_of(e.value).alias("text"))
    part = lambda e, name: text_of(field(e.value, name)).alias(name)
    pinned = lambda e: F.struct(e.key.alias("key"), json_kind(e.value).alias("kind"), part(e, "path"), part(e, "ref"), part(e, "blob"))
    # numbers and flags of one value are repeats of each other, as 1, 1.0 and true
    number = lambda e: F.coalesce(F.try_variant_get(e, "$", "double"), F.try_variant_get(e, "$", "boolean").cast("double")).cast("string")
    value = lambda e: F.when(json_kind(e).isin("int", "real", "boolean"), number(e)).otherwise(F.to_json(e))
    listed = F.coalesce(F.try_variant_get(c("_f_delete_files"), "$", "array<variant>"), F.array().cast("array<variant>"))
    found = found.withColumns({
        "_schema": text_of(c("_f_schema")), "_id": text_of(c("_f_bundle_id")), "_ref": text_of(c("_f_base_source_ref")), "_files": F.transform(members("files"), typed), "_changed": F.transform(members("changed_files"), typed),
        "_hashes": F.transform(members("sha256"), typed), "_inputs": F.transform(members("inputs"), pinned), "_deleted": F.transform(listed, lambda e: F.struct(value(e).alias("value"), text_of(e).alias("text"))),
        "_seconds": F.when(c("_k_timeout_seconds") == "int", F.try_variant_get(c("_f_timeout_seconds"), "$", "bigint")), "_strict": strict_json(c("raw")),
    })
    keys = lambda n: F.transform(n, lambda e: e.key)
    found = found.withColumns({"_names": keys("_files"), "_edits": keys("_changed"), "_gone": F.transform("_deleted", lambda e: e.text), "_hashed": F.map_from_entries("_hashes")})
    has = lambda name: c(f"_f_{name}").isNotNull()
    kind = lambda name: c(f"_k_{name}")
    low, high = SECONDS
    repeats = F.size(F.array_distinct(F.transform("_deleted", lambda e: e.value))) != F.size("_deleted")
    # The codes of the format, in its order.
    successor = (
        F.when(has("files") | has("sha256"), "successor_ambiguous_source_fields").when(~fullmatch(c("_ref"), OBJECT_ID), "invalid_base_source_ref")
        .when(has("changed_files") & (kind("changed_files") != "object"), "invalid_changed_files")
        .when(has("delete_files") & ((kind("delete_files") != "array") | repeats), "invalid_delete_files")
        .when((F.size("_changed") == 0) & (F.size("_deleted") == 0), "successor_no_requested_changes")
        .when(F.exists("_changed", lambda e: ~plain_source_name(e.key) | e.text.isNull()), "invalid_changed_source_entry")
        .when(F.exists("_gone", lambda name: ~plain_source_name(F.coalesce(name, F.lit("")))), "invalid_delete_source_entry")
        .when(F.arrays_overlap("_edits", "_gone"), "successor_change_delete_overlap").when(F.array_contains("_gone", ENTRY_POINT), "cannot_delete_run_task")
    )
    declared = (c("_schema") == BUNDLE_SCHEMAS[0]) | has("sha256")
    differ = (F.size(F.array_except("_names", keys("_hashes"))) > 0) | (F.size(F.array_except(keys("_hashes"), "_names")) > 0)
    entry = lambda e: F.coalesce(F.when(~plain_source_name(e.key) | e.text.isNull(), "invalid_source_entry"), F.when(declared & ~F.sha2(e.text, 256).eqNullSafe(F.try_element_at("_hashed", e.key)), "source_hash_mismatch"))
    whole = (
        F.when(~F.coalesce(kind("files") == "object", F.lit(False)) | (F.size("_files") == 0), "invalid_source_files").when(~F.array_contains("_names", ENTRY_POINT), "invalid_source_manifest")
        .when(declared & (~F.coalesce(kind("sha256") == "object", F.lit(False)) | differ), "invalid_source_manifest").otherwise(_first(c("_files"), entry))
    )
    is_successor = c("_schema") == BUNDLE_SCHEMAS[2]
    hidden = lambda e: F.when(is_successor, F.array_contains("_edits", e.key)).otherwise(F.array_contains("_names", e.key))
    one_input = lambda e: input_error(e.key, e.path, e.ref, e.blob, hidden(e) | (e.kind != "object"))
    error = (
        F.when(~c("_strict"), "invalid_bundle_json")
        .when(~F.coalesce((c("_root") == "object") & c("_schema").isin(*BUNDLE_SCHEMAS) & (c("_id") == c("bundle_id")), F.lit(False)), "bundle_identity_mismatch")
        .otherwise(F.coalesce(
            F.when(is_successor, successor).otherwise(whole), F.when(has("inputs") & (kind("inputs") != "object"), "invalid_inputs"), _first(c("_inputs"), one_input),
            F.when(has("timeout_seconds") & ~F.coalesce(c("_seconds").between(low, high), F.lit(False)), "invalid_timeout"),
        ))
    )
    return found.select(*(c(f"`{x}`") for x in bundles.columns), c("_schema").alias("schema"), error.alias("error"))


def error_category(kind: Column, code: Column) -> Column:
    """Kinds http, transport and others; HTTP codes by class."""
    http = F.when(code == 404, "missing_repository_object").when(code.isin(401, 403), "authorization_or_rate_limit").when((code == 429) | (code >= 500), "remote_service_error").otherwise("remote_request_error")
    return F.when(kind == "http", http).when(kind == "transport", "transport_error").otherwise("validation_or_materialization_error")


def output_name_error(name: Column) -> Column:
    """A saved output's name is a plain base name that no record of the run itself uses."""
    plain = ~blank(name) & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\\")
    return F.when(~F.coalesce(plain, F.lit(False)), "invalid_output_name").when(name.isin("receipt.json", "admission.json"), "reserved_output_name")


def run_request_errors(requests: DataFrame) -> DataFrame:
    """Run requests (keys, schema, bundle_id, wanted_id, source_ref, inputs, timeout_seconds, config_json) with the first broken rule.

    A run names a source by its identity and can't edit it; its configuration is a JSON object or absent. A column
    ``inputs_error`` says what is wrong with inputs that come from earlier requests (``snapshots.inherited_inputs``).
    """
    c = F.col
    inherited = c("inputs_error") if "inputs_error" in requests.columns else F.lit(None).cast("string")
    inputs = F.map_entries(F.coalesce("inputs", F.create_map().cast("map<string,struct<path:string,ref:string,blob:string>>")))
    editing = F.arrays_overlap("keys", F.array(*map(F.lit, ("files", "changed_files", "delete_files", "sha256", "base_source_ref"))))
    bad_input = F.get(F.filter(F.transform(inputs, lambda e: input_error(e.key, e.value.path, e.value.ref, e.value.blob, e.key == SOURCE_MANIFEST)), lambda e: e.isNotNull()), F.lit(0))
    low, high = SECONDS
    configured = F.array_contains("keys", "config")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("config_json")).startswith("OBJECT"), F.lit(False))
    collides = F.exists(inputs, lambda e: e.key == "run_config.json")
    error = (
        F.when(~F.coalesce((c("schema") == "private-run-request/1") & (c("bundle_id") == c("wanted_id")), F.lit(False)), "run_request_identity_mismatch").when(~fullmatch(c("source_ref"), OBJECT_ID), "invalid_run_source_ref")
        .when(editing, "run_request_cannot_edit_source").when(inherited.isNotNull(), inherited).when(bad_input.isNotNull(), bad_input).when(~F.coalesce(c("timeout_seconds").between(low, high), F.lit(True)), "invalid_timeout")
        .when(configured & ~is_object, "invalid_run_config").when(configured & collides, "run_config_input_collision")
    )
    return requests.withColumn("error", error)


def name_collision(inputs: Column, sources: Column, has_config: Column) -> Column:
    """A run's inputs or its configuration hide a source file of the same name, or null."""
    return F.when(F.arrays_overlap(inputs, sources), "input_source_name_collision").when(has_config & F.array_contains(sources, "run_config.json"), "run_config_source_collision")


def receipt_errors(receipts: DataFrame) -> DataFrame:
    """Receipts (schema, bundle_id, bundle_blob, source_ref, status, collection_errors, run_id, run_attempt, files
    and what is wanted: wanted_id, wanted_blob, producer or null) with the first broken rule."""
    c = F.col
    known = (c("schema") == "bundle-computation-receipt/2") & (c("bundle_id") == c("wanted_id")) & (c("bundle_blob") == c("wanted_blob")) & fullmatch(c("source_ref"), OBJECT_ID) & c("status").isin("materialized", "failed_or_partial")
    identity = F.concat(F.coalesce("run_id", F.lit("")), F.lit("-"), F.coalesce("run_attempt", F.lit("")))
    entry_ok = lambda name, digest: output_name_error(name).isNull() & ~name.contains("\x00") & fullmatch(digest, r"[0-9a-f]{64}")
    error = (
        F.when(~F.coalesce(known, F.lit(False)), "result_identity_mismatch").when((c("status") == "materialized") & (F.coalesce("collection_errors", F.lit(0)) > 0), "false_completion_rejected")
        .when(~fullmatch(identity, r"[1-9][0-9]*-[1-9][0-9]*") | F.coalesce(c("producer") != identity, F.lit(False)), "producer_identity_mismatch").when(c("files").isNull(), "invalid_result_manifest")
        .when(F.exists(F.map_entries("files"), lambda e: ~F.coalesce(entry_ok(e.key, e.value), F.lit(False))), "invalid_result_manifest_entry")
    )
    return receipts.withColumns({"identity": identity, "error": error})


def push_triggers(pushes: DataFrame) -> DataFrame:
    """Pushes (commits, added, modified, removed arrays) with the one trigger path that they touch, or an error."""
    changed = F.array_distinct(F.concat("added", "modified", "removed"))
    rest = lambda path: F.substr(path, F.lit(len(SLOT_PREFIX) + 2))
    trigger = F.filter(changed, lambda p: (p == SINGLE_PATH) | (p.startswith(SLOT_PREFIX + "/") & p.endswith(".json") & ~rest(p).contains("/")))
    path = F.get(trigger, F.lit(0))
    error = (
        F.when(~F.coalesce(F.col("commits") == 1, F.lit(False)), "push_must_contain_one_commit").when(F.size(trigger) != 1, "push_must_change_one_trigger")
        .when(F.size(changed) != 1, "trigger_commit_must_be_isolated").when(F.array_contains("removed", path), "trigger_file_removed")
    )
    return pushes.withColumn("error", error).withColumn("path", F.when(F.col("error").isNull(), path))


def output_binding(folder: Column, name: Column, ref: Column, blob: Column) -> Column:
    """A saved output as a pinned input; null unless the name is a base name and the object is there."""
    ok = output_name_error(name).isNull() & blob.isNotNull()
    return F.when(ok, F.struct(F.concat_ws("/", folder, name).alias("path"), ref.alias("ref"), blob.alias("blob")))


def collected_name_error(name: Column) -> Column:
    """What keeps a file of an output folder from being collected, or null."""
    plain = (name != "") & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\\") & ~name.contains("\x00")
    return F.when(name.isin("receipt.json", "admission.json"), "reserved_name").when(~F.coalesce(plain, F.lit(False)), "invalid_filename")


def decoded_files(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored files (type, encoding, content in base64, sha) with ``raw`` bytes, or what is wrong with them."""
    items, raw = items.withColumn("_raw", decoded_base64(F.col("content"))), F.col("_raw")  # a column of its own: decoded once
    large = F.octet_length(raw) > limit if limit is not None else F.lit(False)
    error = (
        F.when(~F.coalesce((F.col("type") == "file") & (F.col("encoding") == "base64") & raw.isNotNull(), F.lit(False)), "expected_base64_file").when(large, "file_too_large")
        .when(~blob_id_of_bytes(raw).eqNullSafe(F.col("sha")), "blob_identity_mismatch")
    )
    return items.withColumn("error", error).withColumn("raw", F.when(F.col("error").isNull(), raw)).drop("_raw")


def over_total(files: DataFrame, by: str, size: Column, limit: int) -> DataFrame:
    """(group, total_bytes, error) where a group's files together exceed ``limit`` bytes."""
    per = files.groupBy(by).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))
    return per.withColumn("error", F.when(F.col("total_bytes") > limit, "total_size_exceeded"))


def run_drafts(receipts: DataFrame) -> DataFrame:
    """Run requests drafted from receipts (bundle_id, source_ref, bundle_blob and others): config and status never pass on."""
    return receipts.select(F.lit("private-run-request/1").alias("schema"), "bundle_id", "source_ref", F.col("bundle_blob").alias("inputs_from"))


EXECUTIONS = "transport/bundle-executions"


def _given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column that callers may leave out."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)


def receipt_rows(runs: DataFrame) -> DataFrame:
    """Receipts of runs (bundle_id, bundle_blob, source_ref, run_id, run_attempt, files map, result_rows, done) and their ``prefix``.

    What else is known of a run goes in as given: exit_code, timed_out, output_limit_exceeded, validation_errors, metadata_errors,
    collection_errors (arrays), result_validation and progress (any type).
    """
    errors = lambda name: F.coalesce(_given(runs, name, "array<string>"), F.array().cast("array<string>")).alias(name)
    # Fixed values of the format.
    return runs.select(
        F.lit("bundle-computation-receipt/2").alias("schema"), "bundle_id", "bundle_blob", "source_ref", "run_id", "run_attempt", F.map_from_entries(F.array_sort(F.map_entries("files"))).alias("files"), "result_rows",
        F.when(F.coalesce("done", F.lit(False)), "materialized").otherwise("failed_or_partial").alias("status"), F.lit("published").alias("publication_status"), F.lit("not_claimed").alias("scientific_completion"),
        F.lit("pending").alias("scientific_review_status"), F.struct(_given(runs, "exit_code", "int").alias("exit_code"), _given(runs, "timed_out", "boolean").alias("timed_out"), _given(runs, "output_limit_exceeded", "boolean").alias("output_limit_exceeded")).alias("execution_status"),
        errors("validation_errors"), _given(runs, "result_validation", "string"), _given(runs, "progress", "string"), errors("metadata_errors"), errors("collection_errors"),
        F.concat_ws("/", F.lit(EXECUTIONS), "bundle_id", F.concat_ws("-", "run_id", "run_attempt")).alias("prefix"), _given(runs, "stage", "string"),
    )


def review_rows(receipts: DataFrame) -> DataFrame:
    """The review queue's rows of ``receipt_rows``: paths of what was saved, null where it wasn't."""
    saved = lambda name: F.when(F.map_contains_key("files", name), F.concat_ws("/", "prefix", F.lit(name)))
    # Fixed values of the format.
    return receipts.select(
        F.lit("private-review-submission/1").alias("schema"), F.lit("pending").alias("review_status"), F.col("status").alias("execution_status"), F.lit("independent_review").alias("next_action"), "scientific_review_status", "stage",
        F.size("validation_errors").alias("validation_error_count"), "bundle_id", "bundle_blob", "source_ref", "run_id", "run_attempt", F.concat_ws("/", "prefix", F.lit("receipt.json")).alias("receipt_path"),
        saved("result.jsonl").alias("result_path"), saved("summary.json").alias("summary_path"), saved("progress.jsonl").alias("progress_path"),
    )


def source_bindings(receipts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Receipts (request_schema, request_source_ref, bundle_id, bundle_blob, source_ref) with ``error`` where the source isn't the request's.

    A run request names its source; any other one's source is the manifest (bundle_id, bundle_blob) kept at source_ref.
    """
    held = manifests.select(F.col("source_ref").alias("_ref"), F.col("bundle_id").alias("_id"), F.col("bundle_blob").alias("_blob"))
    found = receipts.join(held, (F.col("source_ref") == F.col("_ref")) & (F.col("request_schema") != "private-run-request/1"), "left")
    is_run = F.col("request_schema") == "private-run-request/1"
    same = F.col("_id").eqNullSafe(F.col("bundle_id")) & F.col("_blob").eqNullSafe(F.col("bundle_blob"))
    error = F.when(is_run & ~F.col("request_source_ref").eqNullSafe(F.col("source_ref")), "request_result_source_mismatch").when(~is_run & ~same, "source_request_identity_mismatch")
    return found.withColumn("error", error).drop("_ref", "_id", "_blob")


MATERIALIZED = "transport/tasks/bundle-materialized"
SOURCE_SCHEMAS = ["bundle-materialized-source/2", "bundle-materialized-source/3"]


def _commit_key(commit: Column) -> Column:
    """A commit in half the bytes, where it is hex: a sign for the form, then its bytes."""
    return F.when(fullmatch(commit, OBJECT_ID), F.concat(F.unhex(F.lit("01")), F.unhex(commit))).otherwise(F.concat(F.unhex(F.lit("00")), commit.cast("binary")))


def _commit_of(key: Column) -> Column:
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def base_sources(changes: DataFrame, declared: DataFrame, manifests: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """(commit, bundle_id, error) of commits' changed paths (commit, path): one manifest that is sound, and nothing but what it declares.

    ``declared`` holds the manifests' entries (commit, name, sha256), ``manifests`` their heads (commit, schema, bundle_id) and ``contents``
    the files at each commit (commit, path, content in bytes). Without heads (or digests and contents) those checks are left
    out. Entries are judged in the order of their names, each one's form before its content.

    Changes, entries and contents are dealt out by their commit, once, with paths cut at the bundle's folder and digests as bytes; all that follows stays where it is.
    """
    c, key, none = F.col, _commit_key(F.col("commit")).alias("_key"), F.lit(None).cast("binary")
    below = lambda group: F.regexp_extract("path", rf"(?s)\A{MATERIALIZED}/([^/]*)/(.*)\z", group)
    inside = F.coalesce(c("path").startswith(f"{MATERIALIZED}/") & F.substring("path", len(MATERIALIZED) + 2, 2**31 - 1).contains("/"), F.lit(False))
    # the folder is null where it is the bundle's own, whatever that is; "" is none of any bundle
    split = (F.when(inside, below(1)).when(c("path").isNotNull(), "").alias("folder"), F.when(inside, below(2)).alias("name"))
    rows = changes.select(key, *split, F.lit(1).alias("kind"), none.alias("digest"))
    given = declared.where(c("commit").isNotNull())
    if contents is None:
        rows = rows.union(given.select(key, F.lit(None).cast("string"), "name", F.lit(2), none))
    else:
        sound = plain_source_name(F.coalesce("name", F.lit(""))) & fullmatch(c("sha256"), r"[0-9a-f]{64}")
        rows = rows.union(given.select(key, F.lit(None).cast("string"), "name", F.when(sound, 2).otherwise(3), F.when(sound, F.unhex("sha256"))))
        rows = rows.union(contents.where(c("commit").isNotNull() & inside).select(key, *split, F.lit(4), F.unhex(F.sha2(c("content").cast("binary"), 256))))
    of_commit = Window.partitionBy("_key")
    found = F.when((c("kind") == 1) & (c("name") == SOURCE_MANIFEST) & fullmatch(c("folder"), r"bt-[A-Za-z0-9_.\-]{1,64}"), c("folder"))
    rows = rows.withColumns({"_n": F.count(found).over(of_commit), "_bundle": F.max(found).over(of_commit)})
    own = c("folder").isNull() | F.coalesce(c("folder") == c("_bundle"), F.lit(False))
    has = lambda test: F.max(F.coalesce(test, F.lit(False)))
    kind = c("kind")
    per = rows.withColumn("own", own).where("own or kind <> 4").groupBy("_key", "own", "name").agg(
        F.max("_n").alias("_n"), F.max("_bundle").alias("_bundle"), has(kind == 1).alias("changed"), has(kind.isin(2, 3)).alias("listed"), has(kind == 2).alias("sound"), has(kind == 3).alias("formless"),
        has((kind == 4) & c("digest").isNotNull()).alias("held"), has((kind == 4) & c("digest").isNull()).alias("lost"), F.min("digest").alias("low"), F.max("digest").alias("high"),
    )
    bad = F.lit(None).cast("string")
    if contents is not None:  # of several rows of a name, the first code in alphabetical order
        bad = F.when(c("sound") & c("held") & (c("low") != c("high")), "base_source_hash_mismatch").when(c("formless"), "invalid_base_source_entry").when(c("sound") & (c("lost") | ~c("held")), "missing_repository_object")
    wanted = c("own") & (c("listed") | F.coalesce(c("name") == SOURCE_MANIFEST, F.lit(False)))
    met = c("changed") | c("listed")  # else it is only there
    out = per.groupBy("_key").agg(
        F.max("_n").alias("manifests"), F.max("_bundle").alias("bundle_id"), has(c("changed")).alias("there"), has(met & (c("changed") != wanted)).alias("odd"),
        has(c("listed") & (c("name") == ENTRY_POINT)).alias("runs"), F.min(F.when(bad.isNotNull(), F.struct("name", bad.alias("error")))).alias("bad"),
    ).where("there")
    unsound = F.lit(False)
    if manifests is not None:
        out = out.join(manifests.select(key, c("schema").alias("_schema"), c("bundle_id").alias("_id")), "_key", "left")
        unsound = ~F.coalesce(c("_schema").isin(*SOURCE_SCHEMAS) & (c("_id") == c("bundle_id")), F.lit(False))
    out = out.withColumn("commit", _commit_of(c("_key")))
    # The codes of the format, in its order.
    error = (
        F.when(~fullmatch(c("commit"), OBJECT_ID) if contents is not None else F.lit(False), "invalid_base_source_ref").when(c("manifests") != 1, "base_source_manifest_not_unique").when(unsound, "invalid_base_source_manifest")
        .when(~c("runs"), "invalid_base_source_files").when(c("bad").isNotNull(), c("bad.error")).when(c("odd"), "base_source_commit_scope_mismatch")
    )
    return out.select("commit", F.when(c("manifests") == 1, c("bundle_id")).alias("bundle_id"), error.alias("error"))


def successor_lists(base: Column, changed: Column, deleted: Column) -> Column:
    """What a successor does to its base (maps name -> text; an array of names), in sorted lists: requested, actual, unchanged, deleted, inherited."""
    edits = F.map_keys(changed)
    same = F.filter(edits, lambda name: F.try_element_at(base, name).eqNullSafe(F.try_element_at(changed, name)) & F.map_contains_key(base, name))
    actual = F.array_except(edits, same)
    left = F.array_except(F.array_union(F.map_keys(base), edits), deleted)
    named = {"requested_changed_files": edits, "actual_changed_files": actual, "unchanged_overlay_files": same, "deleted_files": deleted, "inherited_files": F.array_except(left, actual)}
    return F.struct(*(F.array_sort(v).alias(k) for k, v in named.items()))


def source_manifests(sources: DataFrame) -> DataFrame:
    """Manifests of bundles' sources (bundle_id, bundle_schema, bundle_blob, base_source_ref): a row each, in the format's fields.

    Given ``files`` (name -> text: all of a bundle's, or what a successor changes), ``inputs`` and ``timeout_seconds``, they are in it; a
    successor's files come with ``base_bundle_id``, ``base_files`` and ``delete_files``, and its lists of what it changed. A bundle's files are
    one value; ``identity.manifest_rows`` has files of any number, a row each.
    """
    c = F.col
    is_text, is_successor = c("bundle_schema") == BUNDLE_SCHEMAS[1], c("bundle_schema") == BUNDLE_SCHEMAS[2]
    none, text_map = F.create_map().cast("map<string,string>"), "map<string,string>"
    files, base = (F.coalesce(_given(sources, n, text_map), none) for n in ("files", "base_files"))
    deleted = F.coalesce(_given(sources, "delete_files", "array<string>"), F.array().cast("array<string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(deleted, k) & ~F.map_contains_key(files, k))
    final = F.when(is_successor, F.map_concat(kept, files)).otherwise(files)
    hashes = F.map_from_entries(F.array_sort(F.transform(F.map_entries(final), lambda e: F.struct(e.key.alias("key"), F.sha2(e.value, 256).alias("value")))))
    # in columns of their own first: beside an output column named files, the expressions would mean that one
    made = sources.withColumns({"_hashes": hashes, "_successor": F.when(is_successor, successor_lists(base, files, deleted))})
    # Fixed values of the format.
    return made.select(
        "bundle_id", F.when(is_successor, SOURCE_SCHEMAS[1]).otherwise(SOURCE_SCHEMAS[0]).alias("schema"), F.concat(F.lit("transport/bundle_inbox/"), "bundle_id", F.lit(".json")).alias("bundle_path"), "bundle_blob", c("_hashes").alias("files"),
        _given(sources, "inputs", "map<string,struct<path:string,ref:string,blob:string>>"), _given(sources, "timeout_seconds", "long"), F.when(is_text | is_successor, c("bundle_schema")).alias("submission_schema"),
        F.when(is_text, "actions_received_utf8").when(is_successor, "actions_received_utf8_overlay").alias("source_hash_authority"), F.when(is_successor, c("base_source_ref")).alias("parent_source_ref"),
        F.when(is_successor, _given(sources, "base_bundle_id", "string")).alias("parent_bundle_id"), c("_successor").alias("successor"),
    )


def source_origins(requests: DataFrame, manifests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests (bundle_id, bundle_blob, source_ref) with ``origin``, the commit that wrote their source, or ``error``.

    ``manifests`` (source_ref, bundle_id, bundle_blob, digest) are the manifests as they stand at commits; ``history`` (source_ref, bundle_id, origin)
    the last commit, seen from each source_ref, that changed the bundle's manifest. Another commit counts where it holds the same manifest.
    """
    c = F.col
    here = manifests.select("source_ref", F.struct("bundle_id", "bundle_blob", "digest").alias("_here"))
    there = manifests.select(c("source_ref").alias("_origin"), F.struct("bundle_id", "digest").alias("_there"))
    past = history.select("source_ref", "bundle_id", c("origin").alias("_origin"))
    met = requests.join(here, "source_ref", "left").join(past, ["source_ref", "bundle_id"], "left").join(there, "_origin", "left")
    error = (
        F.when(c("_here").isNull(), "missing_repository_object").when((c("_here.bundle_id") != c("bundle_id")) | ~c("_here.bundle_blob").eqNullSafe(c("bundle_blob")), "materialized_manifest_identity_mismatch")
        .when(~fullmatch(c("_origin"), OBJECT_ID), "source_origin_unresolved")
        .when((c("_origin") != c("source_ref")) & ~F.coalesce((c("_there.bundle_id") == c("bundle_id")) & (c("_there.digest") == c("_here.digest")), F.lit(False)), "source_origin_identity_mismatch")
    )
    return met.withColumn("error", error).select(*requests.columns, F.when(c("error").isNull(), c("_origin")).alias("origin"), "error")
