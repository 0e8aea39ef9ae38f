"""Requests, triggers, snapshots, chains, create-only tables."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strataforge.operators import contracts, lifecycle, snapshots
from strataforge.streaming import create_only_stream

REQUEST = "keys array<string>, version int, id string, lane string, slot int, request_path string"


@pytest.mark.parametrize(
    ("row", "error", "schema"),
    [
        ((["id"], None, "a1", None, None, None), None, "scoped-private-trigger/1"),
        ((["id"], None, "a1\n", None, None, None), "invalid_trigger_id", None),
        ((["version", "id"], 2, "a1", None, None, "else.json"), "v2_request_path_mismatch", None),
        ((["version", "id", "lane", "slot"], 3, "a1", "descriptor", 19, None), None, "scoped-private-trigger/3"),
        ((["version", "id", "lane", "slot"], 3, "a1", "descriptor", 20, None), "execution_slot_out_of_range", None),
        ((["version", "id", "lane", "slot"], 3, "a1", "ml", 7, "private_job/slots/ml-06.json"), "slot_request_path_mismatch", None),
        ((["version", "id", "lane", "slot"], 3, "a1", "gpu", 0, None), "invalid_execution_lane", None),
        ((["version", "id", "lane", "slot"], 3, "a1", "ml", None, None), "invalid_execution_slot", None),
        ((["id", "extra"], 2, "a1", None, None, None), "unsupported_request_shape", None),
    ],
)
def test_requests(spark, row, error, schema):
    got = contracts.resolve_requests(spark.createDataFrame([row], REQUEST)).collect()[0]
    assert (got.error, got.schema) == (error, schema)


def test_triggers(spark):
    columns = "action string, is_pull_request boolean, actor string, owner string, triggering_actor string, author string, title string, body string"
    good = ("opened", False, "o", "o", None, "o", " bundle-task:bt-1 ", None)
    swap = lambda **x: tuple(x.get(n, v) for n, v in zip((c.split()[0] for c in columns.split(", ")), good))
    rows = [good, swap(body="id=bt-1\n\n schema=private-bundle-trigger/2"), swap(body="id=bt-1"), swap(action="closed"), swap(author="x"), swap(title="bundle-task:bt-1 x"), swap(is_pull_request=True), swap(triggering_actor="x"), swap(body="\x1did=bt-1\u2028schema=private-bundle-trigger/2\x0b"), swap(body="id=bt-1\x0bid=bt-1")]
    got = [r.reason for r in contracts.trigger_decisions(spark.createDataFrame(rows, columns)).collect()]
    assert got == ["authorized", "authorized", "unexpected_public_body", "unsupported_event", "owner_required", "invalid_trigger", "invalid_trigger", "owner_required", "authorized", "unexpected_public_body"]


def test_overlay(spark):
    kv = "name string, text string"
    base = spark.createDataFrame([("run_task.py", "1"), ("helper.py", "2"), ("same.py", "3")], kv)
    changes = spark.createDataFrame([("run_task.py", "9"), ("same.py", "3"), ("new.py", "4")], kv)
    deletes = spark.createDataFrame([("helper.py",), ("gone.py",)], "name string")
    got = {r.name: (r.status, r.text) for r in snapshots.overlay(base, changes, deletes, "name", "text").collect()}
    assert got == {"run_task.py": ("changed", "9"), "new.py": ("changed", "4"), "same.py": ("unchanged", "3"), "helper.py": ("deleted", None), "gone.py": ("missing_delete", None)}


def test_chain(spark):
    requests = spark.createDataFrame([("r0", None), ("r1", "r0"), ("r2", "r1"), ("c1", "c2"), ("c2", "c1"), ("m", "nowhere")], "node string, parent string")
    roots = spark.createDataFrame([("r2",), ("c1",), ("m",)], "n string")
    chain = snapshots.request_chain(requests, "node", "parent", roots)
    assert sorted((r.root, r.node, r.error) for r in chain.where("error is not null").collect()) == [("c1", "c1", "cyclic_chain"), ("m", "nowhere", "missing_parent")]
    entries = spark.createDataFrame([("r0", "a", 1), ("r0", "b", 2), ("r1", "a", 3), ("r2", "c", 4)], "node string, k string, v int")
    merged = snapshots.merge_layers(chain, entries, "node", "k", "v").where("root = 'r2'")
    assert {r.k: r.v for r in merged.collect()} == {"a": 3, "b": 2, "c": 4}


def test_long_chains_and_loops(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(70)] + [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "x")]
    chain = snapshots.request_chain(spark.createDataFrame(rows, "node string, parent string"), "node", "parent", spark.createDataFrame([("n69",), ("a",), ("x",)], "n string")).collect()
    by = lambda root: sorted((r.depth, r.node, r.error) for r in chain if r.root == root)
    assert by("n69") == [(k, f"n{69 - k}", None) for k in range(70)]
    assert by("a") == [(0, "a", None), (1, "b", None), (2, "c", None), (3, "d", None), (4, "b", "cyclic_chain")]
    assert by("x") == [(0, "x", None), (1, "x", "cyclic_chain")]


def test_overlay_verdicts(spark):
    rows = [("ok", "run_task.py", "inherited"), ("ok", "m", "changed"), ("gone", "run_task.py", "deleted"), ("miss", "run_task.py", "inherited"), ("miss", "x", "missing_delete"), ("same", "run_task.py", "unchanged")]
    got = {r.b: r.error for r in snapshots.overlay_verdicts(spark.createDataFrame(rows, "b string, name string, status string"), "b", "name").collect()}
    assert got == {"ok": None, "gone": "invalid_final_source_manifest", "miss": "successor_delete_missing_file", "same": "successor_no_effect"}


REF = "a" * 40
SUCCESSOR = {"schema": "private-task-bundle/4", "bundle_id": "bt-u", "base_source_ref": REF, "changed_files": {"helper.py": "VALUE = 2\n"}, "delete_files": ["old.py"], "inputs": {}, "timeout_seconds": 60}
WHOLE = {"schema": "private-task-bundle/3", "bundle_id": "bt-u", "files": {"run_task.py": "x"}}


@pytest.mark.parametrize(
    ("base", "change", "error"),
    [
        (SUCCESSOR, {}, None), (SUCCESSOR, {"files": None}, "successor_ambiguous_source_fields"), (SUCCESSOR, {"base_source_ref": "no"}, "invalid_base_source_ref"), (SUCCESSOR, {"base_source_ref": 5}, "invalid_base_source_ref"),
        (SUCCESSOR, {"changed_files": [1]}, "invalid_changed_files"), (SUCCESSOR, {"delete_files": {}}, "invalid_delete_files"), (SUCCESSOR, {"delete_files": ["a", "a"]}, "invalid_delete_files"), (SUCCESSOR, {"changed_files": {}, "delete_files": []}, "successor_no_requested_changes"),
        (SUCCESSOR, {"changed_files": {"../bad.py": "x"}}, "invalid_changed_source_entry"), (SUCCESSOR, {"changed_files": {"x.py": 1}}, "invalid_changed_source_entry"), (SUCCESSOR, {"delete_files": [1]}, "invalid_delete_source_entry"), (SUCCESSOR, {"delete_files": ["BUNDLE_SOURCE.json"]}, "invalid_delete_source_entry"),
        (SUCCESSOR, {"delete_files": ["helper.py"]}, "successor_change_delete_overlap"), (SUCCESSOR, {"delete_files": ["run_task.py"]}, "cannot_delete_run_task"), (SUCCESSOR, {"inputs": [1]}, "invalid_inputs"), (SUCCESSOR, {"timeout_seconds": True}, "invalid_timeout"), (SUCCESSOR, {"timeout_seconds": 29}, "invalid_timeout"),
        (SUCCESSOR, {"inputs": {"helper.py": {"path": "inputs/a", "ref": REF, "blob": REF}}}, "invalid_input_entry"), (SUCCESSOR, {"inputs": {"BUNDLE_SOURCE.json": {"path": "inputs/a", "ref": REF, "blob": REF}}}, None), (SUCCESSOR, {"inputs": {"a": 1}}, "invalid_input_entry"), (SUCCESSOR, {"inputs": {"a": {"path": "x", "ref": REF, "blob": REF}}}, "input_path_not_allowed"),
        (SUCCESSOR, {"inputs": {"a": {"path": "inputs/a", "ref": REF}}}, "input_identity_invalid"), (SUCCESSOR, {"bundle_id": "bt-v"}, "bundle_identity_mismatch"), (SUCCESSOR, {"schema": "private-task-bundle/9"}, "bundle_identity_mismatch"), (WHOLE, {}, None), (WHOLE, {"files": {}}, "invalid_source_files"), (WHOLE, {"files": {"a": "x"}}, "invalid_source_manifest"),
        (WHOLE, {"sha256": None}, "invalid_source_manifest"), (WHOLE, {"sha256": {"run_task.py": "0"}}, "source_hash_mismatch"), (WHOLE, {"schema": "private-task-bundle/2"}, "invalid_source_manifest"), (WHOLE, {"files": {"run_task.py": 1}}, "invalid_source_entry"),
        (WHOLE, {"schema": "private-task-bundle/2", "sha256": {"run_task.py": hashlib.sha256(b"x").hexdigest()}}, None),
    ],
)
def test_bundle_documents(spark, base, change, error):
    row = contracts.bundle_verdicts(spark.createDataFrame([(json.dumps(base | change), "bt-u")], "raw string, bundle_id string")).collect()[0]
    assert row.error == error


def test_texts_that_are_no_bundles(spark):
    rows = spark.createDataFrame([("{", "b"), ("[1]", "b"), ("", "b"), (None, "b")], "raw string, bundle_id string")
    assert [r.error for r in contracts.bundle_verdicts(rows).collect()] == ["invalid_bundle_json", "bundle_identity_mismatch", "invalid_bundle_json", "invalid_bundle_json"]


def test_files_are_judged_one_after_another(spark):
    one = f"named_struct('path', '../p', 'ref', '{REF}', 'blob', '{REF}')"
    two = one.replace("../p", "inputs/p")
    rows = [
        ("map('run_task.py', 'x', '../y', 'y')", "map('run_task.py', '0', '../y', '0')", "null"), ("map('../y', 'y', 'run_task.py', 'x')", "map('run_task.py', '0', '../y', '0')", "null"),
        ("map('run_task.py', 'x')", "null", f"map('a', {one}, 'run_task.py', {two})"), ("map('run_task.py', 'x')", "null", f"map('run_task.py', {two}, 'a', {one})"), ("map('run_task.py', 'x')", "null", f"map('BUNDLE_SOURCE.json', {two})"),
    ]
    frame = spark.sql(" union all ".join(f"select {k} as k, {f} as files, {h} as hashes, {i} as inputs, 30 as timeout_seconds" for k, (f, h, i) in enumerate(rows)))
    assert [r.error for r in contracts.bundle_errors(frame).orderBy("k").collect()] == ["source_hash_mismatch", "invalid_source_entry", "invalid_path", "invalid_input_entry", None]


def test_stored_files(spark):
    raw = b"a\x00\xff" * 50
    blob = hashlib.sha1(b"blob 150\x00" + raw).hexdigest()
    text = base64.encodebytes(raw).decode()
    rows = [("file", "base64", text, blob), ("dir", "base64", text, blob), ("file", "none", text, blob), ("file", "base64", text, "0"), ("file", "base64", None, blob)]
    schema = "type string, encoding string, content string, sha string"
    got = [(r.error, r.raw and bytes(r.raw)) for r in contracts.decoded_files(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(None, raw), ("expected_base64_file", None), ("expected_base64_file", None), ("blob_identity_mismatch", None), ("expected_base64_file", None)]
    assert contracts.decoded_files(spark.createDataFrame(rows[:1], schema), 149).collect()[0].error == "file_too_large"


def test_base_sources(spark):
    at = "transport/tasks/bundle-materialized/bt-a/"
    changes = [("c", at + n) for n in ("BUNDLE_SOURCE.json", "run_task.py")] + [("d", at + n) for n in ("BUNDLE_SOURCE.json", "run_task.py")] + [("d", "unrelated"), ("e", "x"), ("f", at + "BUNDLE_SOURCE.json")]
    declared = [("c", "run_task.py"), ("d", "run_task.py"), ("f", "m.py")]
    got = {r.commit: (r.bundle_id, r.error) for r in contracts.base_sources(spark.createDataFrame(changes, "commit string, path string"), spark.createDataFrame(declared, "commit string, name string")).collect()}
    assert got == {"c": ("bt-a", None), "d": ("bt-a", "base_source_commit_scope_mismatch"), "e": (None, "base_source_manifest_not_unique"), "f": ("bt-a", "invalid_base_source_files")}


def test_lookup_and_folders(spark):
    tree = spark.createDataFrame([("a/b", "blob", "s1"), ("a/c", "tree", "s2"), ("a/c/d", "blob", "s3")], "path string, type string, sha string")
    paths = spark.createDataFrame([("a/b",), ("a/c",), ("zz",)], "path string")
    assert {r.path: (r.sha, r.error) for r in snapshots.lookup_paths(paths, tree).collect()} == {"a/b": ("s1", None), "a/c": (None, "existing_path_not_blob"), "zz": (None, None)}
    assert {r.path for r in snapshots.below(tree, "a").collect()} == {"a/b", "a/c"}


def test_latest_is_numeric(spark):
    rows = spark.createDataFrame([("b", "9", "1", "x"), ("b", "10", "1", "y"), ("b", "10", "2", "z")], "b string, run string, attempt string, v string")
    assert lifecycle.latest_attempts(rows, ["b"], ["run", "attempt"]).collect()[0].v == "z"


def test_bundle_hash_and_collision(spark):
    schema = "files map<string,string>, hashes map<string,string>, inputs map<string,struct<path:string,ref:string,blob:string>>, timeout_seconds int"
    run, ref = {"run_task.py": "x"}, "0" * 40
    rows = [
        (run, {"run_task.py": hashlib.sha256(b"x").hexdigest()}, None, 30), (run, {"run_task.py": "0"}, None, 30), (run, {}, None, 30), (run, None, {"run_task.py": ("inputs/a", ref, ref)}, 30), (run, None, {"a": ("inputs/a", ref, "x")}, 30),
        (run, None, None, 29), (run, None, None, None), ({"x.py": "x"}, None, None, 30), ({"run_task.py": "x", "../y": "x"}, None, None, 30),
    ]
    got = [r.error for r in contracts.bundle_errors(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, "source_hash_mismatch", "invalid_source_manifest", "invalid_input_entry", "input_identity_invalid", "invalid_timeout", None, "invalid_source_manifest", "invalid_source_entry"]


def test_create_only_stream_is_idempotent(spark, tmp_path):
    kv, source, out = "k string, v string", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("b", "2")], kv).write.parquet(source)
    for turn in ("one", "two"):  # the second run reads everything again
        create_only_stream(spark.readStream.schema(kv).parquet(source), "k", "v", out, str(tmp_path / turn)).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", "1"), ("b", "2")]
    spark.createDataFrame([("a", "9")], kv).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="other content"):
        create_only_stream(spark.readStream.schema(kv).parquet(source), "k", "v", out, str(tmp_path / "three")).awaitTermination()


def test_names_and_delivery(spark):
    names = spark.createDataFrame([("a.txt",), ("",), ("..",), ("a/b",), ("receipt.json",)], "n string").select(contracts.output_name_error(F.col("n")).alias("e")).collect()
    assert [r.e for r in names] == [None, "invalid_output_name", "invalid_output_name", "invalid_output_name", "reserved_output_name"]
    changes = spark.createDataFrame([("a", "added"), ("b", "removed"), ("c", "added")], "path string, status string")
    assert {r.path for r in lifecycle.outside_delivery(changes, spark.createDataFrame([("a",), ("b",)], "path string"), "path").collect()} == {"b", "c"}


def test_run_requests(spark):
    schema = "keys array<string>, schema string, bundle_id string, wanted_id string, source_ref string, inputs map<string,struct<path:string,ref:string,blob:string>>, timeout_seconds int, config_json string"
    ref = "0" * 40
    good = (["schema", "config"], "private-run-request/1", "b", "b", ref, None, 30, '{"a":18}')
    names = [c.split()[0] for c in "keys k, schema k, bundle_id k, wanted_id k, source_ref k, inputs k, timeout_seconds k, config_json k".split(", ")]
    swap = lambda **x: tuple(x.get(n, v) for n, v in zip(names, good))
    rows = [good, swap(bundle_id="c"), swap(source_ref="x"), swap(keys=["files"]), swap(inputs={"a": ("../a", ref, ref)}), swap(timeout_seconds=1801), swap(config_json="[1]"), swap(inputs={"run_config.json": ("inputs/a", ref, ref)}), swap(keys=["schema"], config_json=None)]
    got = [r.error for r in contracts.run_request_errors(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, "run_request_identity_mismatch", "invalid_run_source_ref", "run_request_cannot_edit_source", "invalid_path", "invalid_timeout", "invalid_run_config", "run_config_input_collision", None]
    rows = spark.createDataFrame([(["a"], ["a"], False), (["a"], ["run_config.json"], True), (["a"], ["b"], True)], "i array<string>, s array<string>, c boolean")
    assert [r.e for r in rows.select(contracts.name_collision(F.col("i"), F.col("s"), F.col("c")).alias("e")).collect()] == ["input_source_name_collision", "run_config_source_collision", None]


def test_receipts(spark):
    schema = "schema string, bundle_id string, bundle_blob string, source_ref string, status string, collection_errors int, run_id string, run_attempt string, files map<string,string>, wanted_id string, wanted_blob string, producer string"
    names, digest = [c.split()[0] for c in schema.split(", ")], "a" * 64
    good = ("bundle-computation-receipt/2", "b", "x", "0" * 40, "materialized", 0, "12", "1", {"result.jsonl": digest}, "b", "x", "12-1")
    swap = lambda **x: tuple(x.get(n, v) for n, v in zip(names, good))
    rows = [good, swap(bundle_blob="y"), swap(status="done"), swap(collection_errors=1), swap(run_id="012"), swap(producer="12-2"), swap(files=None), swap(files={"receipt.json": digest}), swap(files={"a": "b"}), swap(producer=None, status="failed_or_partial", collection_errors=2)]
    got = [r.error for r in contracts.receipt_errors(spark.createDataFrame(rows, schema)).collect()]
    assert got == [None, "result_identity_mismatch", "result_identity_mismatch", "false_completion_rejected", "producer_identity_mismatch", "producer_identity_mismatch", "invalid_result_manifest", "invalid_result_manifest_entry", "invalid_result_manifest_entry", None]


def test_pushes_and_bindings(spark):
    slot = "private_job/slots/ml-01.json"
    rows = [(1, [], [slot], []), (2, [], [slot], []), (1, [slot], ["private_job/request.json"], []), (1, [], [slot, "README"], []), (1, [], [], [slot]), (1, [], ["private_job/slots/a/b.json"], [])]
    got = [(r.path, r.error) for r in contracts.push_triggers(spark.createDataFrame(rows, "commits int, added array<string>, modified array<string>, removed array<string>")).collect()]
    assert got == [(slot, None), (None, "push_must_contain_one_commit"), (None, "push_must_change_one_trigger"), (None, "trigger_commit_must_be_isolated"), (None, "trigger_file_removed"), (None, "push_must_change_one_trigger")]
    rows = spark.createDataFrame([("d", "a.json", "r", "s"), ("d", "../a", "r", "s"), ("d", "a", "r", None)], "f string, n string, r string, b string")
    assert [r.o and r.o.path for r in rows.select(contracts.output_binding(*map(F.col, "fnrb")).alias("o")).collect()] == ["d/a.json", None, None]
