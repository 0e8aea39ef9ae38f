"""Inherited inputs, base sources, successors, wheels and installed versions in small cases of their own."""

import hashlib

from pyspark.sql import functions as F

from strataforge.functions import blob_id, config_text
from strataforge.operators import contracts, identity, snapshots

A, B, C, D = (x * 40 for x in "abcd")
SPEC = "map<string,struct<path:string,ref:string,blob:string>>"


def spec(path):
    return {"path": path, "ref": A, "blob": B}


def test_inherited_inputs(spark):
    run = snapshots.RUN_SCHEMA
    saved = spark.createDataFrame([(A, run, B, {"x": spec("a/x"), "y": spec("a/y")}), (B, "private-task-bundle/2", "ignored", {"y": spec("b/y"), "z": spec("b/z")}), (C, run, D, {}), (D, run, C, None), ("e" * 40, "other/1", None, None), ("f" * 40, run, "short", None)], f"blob string, schema string, inputs_from string, inputs {SPEC}")
    asked = spark.createDataFrame([("all", run, A, {"x": spec("own/x")}), ("none", run, None, {"k": spec("own/k")}), ("cycle", run, C, None), ("other", run, "e" * 40, None), ("short", run, "f" * 40, None), ("bad", run, "zz", None), ("gone", run, "9" * 40, None), ("bundle", "private-task-bundle/3", "zz", None)], f"request string, schema string, inputs_from string, inputs {SPEC}")
    got = {r.request: (r.inputs_error, {k: v.path for k, v in (r.inputs or {}).items()}) for r in snapshots.inherited_inputs(asked, saved).collect()}
    assert got["all"] == (None, {"x": "own/x", "y": "a/y", "z": "b/z"}) and got["none"] == (None, {"k": "own/k"}) and got["bundle"][0] is None
    assert {k: got[k][0] for k in ("cycle", "other", "short", "bad", "gone")} == {"cycle": "cyclic_inputs_from", "other": "inputs_from_not_a_request", "short": "invalid_inputs_from", "bad": "invalid_inputs_from", "gone": "missing_repository_object"}


def test_base_sources(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    folder = lambda k: f"{contracts.MATERIALIZED}/bt-{k}/"
    commits = {k: (str(n) * 40 if k != "ref" else "short") for n, k in enumerate(("good", "schema", "norun", "entry", "hash", "gone", "scope", "two", "ref"))}
    changes, declared, heads, contents = [], [], [], []
    for k, commit in commits.items():
        names = ["a.py", "run_task.py"] if k != "norun" else ["a.py"]
        names += ["../b"] * (k == "entry")
        changes += [(commit, folder(k) + "BUNDLE_SOURCE.json"), *((commit, folder(k) + n) for n in names)] + [(commit, "more")] * (k == "scope") + [(commit, folder("x") + "BUNDLE_SOURCE.json")] * (k == "two")
        declared += [(commit, n, sha(n) if (k, n) != ("hash", "a.py") else sha("else")) for n in names]
        heads.append((commit, "other/1" if k == "schema" else contracts.SOURCE_SCHEMAS[1], f"bt-{k}"))
        contents += [(commit, folder(k) + n, bytearray(n.encode())) for n in names if (k, n) != ("gone", "run_task.py")]
    frames = [spark.createDataFrame(rows, f"commit string, {more}") for rows, more in ((changes, "path string"), (declared, "name string, sha256 string"), (heads, "schema string, bundle_id string"), (contents, "path string, content binary"))]
    got = {r.commit: r.error for r in contracts.base_sources(*frames).collect()}
    want = {"good": None, "schema": "invalid_base_source_manifest", "norun": "invalid_base_source_files", "entry": "invalid_base_source_entry", "hash": "base_source_hash_mismatch", "gone": "missing_repository_object", "scope": "base_source_commit_scope_mismatch", "two": "base_source_manifest_not_unique", "ref": "invalid_base_source_ref"}
    assert got == {commits[k]: e for k, e in want.items()}
    assert got == {r.commit: r.error for r in contracts.base_sources(*frames).collect()}


def test_successor_lists(spark):
    maps = "map<string,string>"
    row = spark.createDataFrame([({"a": "1", "b": "2", "c": "3", "run_task.py": "r"}, {"a": "1", "b": "x", "n": "9"}, ["c"])], f"base {maps}, files {maps}, gone array<string>")
    got = row.select(contracts.successor_lists(F.col("base"), F.col("files"), F.col("gone")).alias("s")).first().s.asDict()
    assert got == {"requested_changed_files": ["a", "b", "n"], "actual_changed_files": ["b", "n"], "unchanged_overlay_files": ["a"], "deleted_files": ["c"], "inherited_files": ["a", "run_task.py"]}
    receipt = contracts.receipt_rows(spark.createDataFrame([("b", "x", "s", "1", "1", {"z": "1", "a": "2"}, 3, True)], f"bundle_id string, bundle_blob string, source_ref string, run_id string, run_attempt string, files {maps}, result_rows int, done boolean"))
    assert len(receipt.drop("prefix", "stage").columns) == 18 and contracts.review_rows(receipt).first().validation_error_count == 0


def test_reads_by_blob(spark):
    blob = spark.range(1).select(blob_id(F.lit("text"))).first()[0]
    held = spark.createDataFrame([("r", "held", "blob", blob, 4, bytearray(b"text")), ("r", "body", "blob", blob, 4, None), ("r", "wrong", "blob", blob, 4, bytearray(b"other")), ("r", "lost", "blob", A, 4, None)], "ref string, path string, type string, sha string, size long, content binary")
    asked = spark.createDataFrame([("r", p, None, None) for p in ("held", "body", "wrong", "lost", "none")] + [("r", "body", blob, 3)], "ref string, path string, expected_blob string, size_limit long")
    blobs = spark.createDataFrame([(blob, bytearray(b"text"))], "sha string, content binary")
    got = sorted((r.path, r.error or bytes(r.content).decode()) for r in snapshots.pinned_reads(asked, held, blobs).collect())
    assert got == [("body", "file_too_large"), ("body", "text"), ("held", "text"), ("lost", "missing_repository_object"), ("none", "missing_repository_object"), ("wrong", "blob_identity_mismatch")]


def test_wheels_and_versions(spark):
    files = spark.createDataFrame([("a", "x-1.whl", True, bytearray(b"1")), ("a", "y-2.WHL", True, bytearray(b"22")), ("b", "x.whl", True, bytearray(b"1")), ("b", "readme", True, bytearray(b"1")), ("c", "d.whl", False, None), ("d", ".whl", True, bytearray(b"1")), ("e", "y-2.WHL", True, bytearray(b"22")), ("e", "x-1.whl", True, bytearray(b"1"))], "folder string, name string, regular boolean, content binary")
    got = {r.folder: r for r in identity.wheel_rows(spark.createDataFrame([(x,) for x in "abcdef"], "folder string"), files, "folder").collect()}
    other = "wheelhouse contains a non-wheel entry"
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": other, "c": other, "d": other, "e": None, "f": "wheelhouse is empty"}
    assert (got["a"].wheel_count, got["a"].wheel_bytes) == (2, 3) and got["a"].manifest_sha256 == got["e"].manifest_sha256
    pins = spark.createDataFrame([("l", "a", "1"), ("l", "b", "2"), ("l", "c", "3")], "file string, normalized string, version string")
    have = spark.createDataFrame([("l", "a", "1"), ("l", "b", "9")], "file string, normalized string, version string")
    assert sorted((r.name, r.problem) for r in identity.installed_errors(pins, have).collect()) == [("b", "version_mismatch"), ("c", "missing")]


def test_config_text(spark):
    rows = spark.createDataFrame([('{"b":[1,2.0],"a":"é"}',), ("[1]",), ("NaN",), (None,)], "t string")
    assert [r.c for r in rows.select(config_text(F.col("t")).alias("c")).collect()] == ['{"a": "é", "b": [1, 2.0]}\n', None, None, None]
