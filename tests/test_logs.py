"""Structures, result and progress logs from files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strataforge import functions as fn
from strataforge.operators import progress, results, structures
from strataforge.sources import lines_of, lock_verdicts, paged, read_bounded, read_lines, read_outputs, read_pins, write_json_array


def test_line_splits(spark):
    text = "a\r\nb\n\nc\rd\x0be"
    frame = spark.createDataFrame([(text,), ("x\n",), ("",)], "t string")
    got = {k: [[(r.line, r.raw, r.terminated) for r in row.l] for row in frame.select(lines_of(F.col("t"), k).alias("l")).collect()] for k in ("bytes", "universal", "unicode")}
    assert got["bytes"][0] == [(1, "a\r", True), (2, "b", True), (3, "", True), (4, "c\rd\x0be", False)]
    assert got["universal"][0] == [(1, "a", True), (2, "b", True), (3, "", True), (4, "c", True), (5, "d\x0be", False)]
    assert [r[1] for r in got["unicode"][0]] == ["a", "b", "", "c", "d", "e"]
    assert got["bytes"][1] == [(1, "x", True)] and got["bytes"][2] == []


def test_structures(spark, tmp_path):
    lines = ['{"id":"a","species":["Si","O","O"],"source_index":8,"target":99}', "", '{"id":"b","species":["Fe"],"source_index":2,"target":12}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    raw = read_lines(spark, str(tmp_path / "s.jsonl")).where("raw <> ''")
    rows = raw.select("line", "raw", F.from_json("raw", "id string, species array<string>, source_index bigint, source_line bigint").alias("r")).select("line", "raw", "r.*")
    index = structures.structure_index(rows).orderBy("source_line").collect()
    assert [(r.id, r.natoms, r.source_line, r.composition) for r in index] == [("a", 3, 1, {"O": 2, "Si": 1}), ("b", 1, 3, {"Fe": 1})]
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k string" if isinstance(x[0], str) else "k long")
    out = str(tmp_path / "out")
    structures.write_selection(rows, out, ids=keys("b"))
    assert [r.value for r in spark.read.text(out).collect()] == [lines[2]]
    with pytest.raises(ValueError, match="missing"):
        structures.write_selection(rows, str(tmp_path / "none"), ids=keys("c"))
    assert not (tmp_path / "none").exists()
    full = rows.withColumn("source_line", F.coalesce("source_line", "line"))
    assert structures.select_records(full, keys("a"), keys(3)).count() == 2
    assert structures.select_records(full).count() == 2


def test_strict_json(spark):
    good = ["{}", "[1]", "1", '"x"', "null", '{"x":1}', "1e999"]
    bad = ['{"x":1} trailing', '{"x":1}{"y":2}', "NaN", "[-Infinity]", "{'x':1}", "{x:1}", "[1,]", "", "01", '{"x":1}],[{"y":1}', '{"x":1}} junk']
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select(fn.strict_json(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    ("text", "expected", "want"),
    [
        (None, None, ("missing", None, 0, None)),
        ("", None, ("invalid", "empty", 0, None)),
        ('{"a":1}\n{not-json}\n', None, ("invalid", "invalid_json", 1, 2)),
        ('{"a":1}\n \n', None, ("invalid", "blank_line", 1, 2)),
        ('{"a":1}\n[1]\n', None, ("invalid", "non_object_row", 1, 2)),
        ('{"a":1}\n{"b":2}\n', 2, ("valid", None, 2, None)),
        ('{"a":1}\n', 2, ("invalid", "row_count_mismatch", 1, None)),
    ],
)
def test_result_verdicts(spark, text, expected, want):
    lines = spark.createDataFrame([("f", text or "")], "file string, t string").select("file", F.explode(lines_of(F.col("t"), "universal")).alias("l")).select("file", "l.*")
    files = spark.createDataFrame([("f", None if text is None else len(text), expected)], "file string, size long, expected_rows long")
    row = results.result_verdicts(lines, files).collect()[0]
    assert (row.status, row.reason, row.records, row.line) == want


def record(processed, elapsed, name=None, item=None, **more):
    return json.dumps({"schema": progress.TAG, "processed": processed, "elapsed_seconds": elapsed, "last_id": name, "item_seconds": item, **more})


def summary(spark, text, wall=None, budget=None):
    lines = spark.createDataFrame([("f", text)], "file string, t string").select("file", F.explode(lines_of(F.col("t"), "unicode")).alias("l")).select("file", "l.*")
    out = progress.progress_summary(progress.monotony_errors(progress.parsed_progress(lines)))
    out = out.withColumns({"timed_out": F.lit(wall is not None), "wall_seconds": F.lit(wall).cast("double"), "timeout_budget_seconds": F.lit(budget).cast("double")})
    return progress.timeout_pattern(out).collect()[0]


def test_progress(spark):
    rows = "\n".join([record(1, 2.0, "a", 2.0, total=4), record(2, 5.0, "b", 3.0, total=4), record(3, 9.0, "c", 4.0, total=4)]) + "\n"
    r = summary(spark, rows, 12.5)
    assert (r.status, r.records, r.median_item_seconds, r.slowest_item_seconds, r.slowest_id, r.seconds_since_last_progress, r.timeout_pattern) == ("valid", 3, 3.0, 4.0, "c", 3.5, "timeout_recent_progress")
    r = summary(spark, record(1, 1.5, "a", 1.5) + '\n{"schema": "descr', 130)
    assert (r.status, r.truncated_final_line, r.records, r.timeout_pattern) == ("partial", True, 1, "timeout_long_gap_since_progress")
    r = summary(spark, record(1, 2.0, "a", 2.0) + "\n" + record(2, 5.0, "b", 3.0) + "\n", 1800, 1800)
    assert (r.median_item_seconds, r.timeout_pattern) == (2.5, "timeout_long_gap_since_progress")


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("  ", "blank_line"), ("{x", "invalid_json"), ('{"schema":"other"}', "invalid_progress_record"), (record(-1, 1), "invalid_processed"), (record(True, 1), "invalid_processed"),
        (record(2, 3, total=1), "invalid_total"), (record(2, -1), "invalid_elapsed"), (record(2, 3, 7), "invalid_last_id"), (record(2, 3, "a", -1), "invalid_item_seconds"), (record(2, 3, phase=1), "invalid_phase"), (record(0, 3), "nonmonotonic_progress"), (record(2, 0.5), "nonmonotonic_progress"),
    ],
)
def test_progress_errors(spark, line, reason):
    r = summary(spark, record(1, 1, "a", 1) + "\n" + line + "\n" + record(9, 9) + "\n")
    assert (r.status, r.reason, r.records, r.line) == ("invalid", reason, 1, 2)


def test_an_invalid_log_has_no_pattern(spark):
    r = summary(spark, record(1, 2.0, "a", 2.0) + "\n{x\n" + record(3, 4.0) + "\n", 500)
    assert (r.status, r.records, r.seconds_since_last_progress, r.long_gap_threshold_seconds, r.timeout_pattern) == ("invalid", 1, None, None, None)
    r = summary(spark, '{"schema": "descr', 130)
    assert (r.status, r.reason, r.records, r.timeout_pattern) == ("partial", "truncated_final_line", 0, None)
    r = summary(spark, record(1, 2.0, "a", 2.0) + "\n", float("nan"))
    assert (r.status, r.timeout_pattern) == ("valid", "timeout_progress_present_wall_unknown")


def test_logs_that_are_missing_or_empty(spark):
    lines = spark.createDataFrame([("ok", record(1, 1, "a", 1) + "\n")], "file string, t string").select("file", F.explode(lines_of(F.col("t"), "unicode")).alias("l")).select("file", "l.*")
    files = spark.createDataFrame([("ok", 9), ("gone", None), ("empty", 0), ("bare", 3)], "file string, size long")
    out = progress.progress_summary(progress.monotony_errors(progress.parsed_progress(lines)), files=files)
    out = progress.timeout_pattern(out.withColumns({"timed_out": F.lit(True), "wall_seconds": F.lit(30.0), "timeout_budget_seconds": F.lit(None).cast("double")}))
    got = {r.file: (r.status, r.reason, r.records, r.timeout_pattern) for r in out.collect()}
    assert got == {"ok": ("valid", None, 1, "timeout_recent_progress"), "gone": ("missing", None, 0, "timeout_no_progress_records"), "empty": ("invalid", "empty", 0, None), "bare": ("invalid", "no_valid_records", 0, None)}


def test_a_separator_does_not_end_the_last_line(spark):
    r = summary(spark, record(1, 1.5, "a", 1.5) + "\n{x\u2028", 130)
    assert (r.status, r.truncated_final_line) == ("partial", True)


def test_slowest_is_the_first_of_equals(spark):
    assert summary(spark, "\n".join(record(k, k, f"i{k}", 5.0) for k in range(1, 4)) + "\n").slowest_id == "i1"


def test_pins_and_bounds(spark, tmp_path):
    (tmp_path / "lock.txt").write_text("num_py==1.0\nNum-Py==1.1\nbad>=2\nlast==3")
    assert [r.error for r in read_pins(spark, str(tmp_path / "lock.txt")).orderBy("line").collect()] == [None, "duplicate_distribution", "not_exact_pin", "missing_final_newline"]
    assert read_bounded(spark, str(tmp_path / "lock.txt"), 100).count() == 1
    with pytest.raises(Exception, match="file too large"):
        read_bounded(spark, str(tmp_path / "lock.txt"), 3).collect()
    (tmp_path / "sep.txt").write_text("a==1\x0cb==2!x~y\n")
    assert [(r.name, r.version, r.error) for r in read_pins(spark, str(tmp_path / "sep.txt")).orderBy("line").collect()] == [("a", "1", None), ("b", "2!x~y", None)]


def test_locks(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("good", "a==1\nb==2\n", digest("a==1\nb==2\n"), 2), ("empty", "\n", digest("\n"), 0), ("none", "", digest(""), 0), ("count", "a==1\n", digest("a==1\n"), 2), ("hash", "a==1\n", "0", 1), ("twice", "a_b==1\nA-B==1\n", digest(""), 2)]
    got = {r.file: (r.package_count, r.error) for r in lock_verdicts(spark.createDataFrame(rows, "file string, text string, expected_sha256 string, expected_count long")).collect()}
    assert got == {"good": (2, None), "empty": (1, "not_exact_pin"), "none": (0, "missing_final_newline"), "count": (1, "package_count_mismatch"), "hash": (1, "lock_hash_mismatch"), "twice": (2, "duplicate_distribution")}


def test_json_array_in_parts(spark, tmp_path):
    rows = spark.range(40).select(F.col("id"), (F.col("id") / 2).alias("half"), F.lit("x").alias("a.b"))
    write_json_array(rows, str(tmp_path / "out"), "id")
    text = "".join((tmp_path / "out" / name).read_text() for name in sorted(os.listdir(tmp_path / "out")) if name.startswith("part-"))
    assert json.loads(text) == [{"id": k, "half": k / 2, "a.b": "x"} for k in range(40)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_json_array(rows, str(tmp_path / "out"), "id")
    with pytest.raises(Exception, match="numbers must be finite"):
        write_json_array(rows.withColumn("half", F.lit(float("nan"))), str(tmp_path / "nan"), "id")
    write_json_array(rows.limit(0), str(tmp_path / "empty"), "id")
    assert json.loads("".join((tmp_path / "empty" / name).read_text() for name in os.listdir(tmp_path / "empty") if name.startswith("part-"))) == []


def test_verdicts_that_must_be_valid(spark):
    files = spark.createDataFrame([("f", "valid", None)], "file string, status string, reason string")
    assert results.require_valid(files).count() == 1 and results.require_valid(files).collect()[0].status == "valid"
    with pytest.raises(Exception, match="row_count_mismatch"):
        results.require_valid(spark.createDataFrame([("f", "invalid", "row_count_mismatch")], files.schema)).collect()


def test_write_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["Si", "O", "O"], 1)], "id string, species array<string>, line long")
    structures.write_index(rows, str(tmp_path / "index"))
    assert [(r.id, r.natoms, r.composition.asDict()) for r in spark.read.json(str(tmp_path / "index")).collect()] == [("a", 3, {"O": 2, "Si": 1})]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        structures.write_index(rows, str(tmp_path / "index"))


def test_output_folder(spark, tmp_path):
    for name, text in (("result.jsonl", "{}\n"), ("receipt.json", "{}"), ("a b+c", "x")):
        (tmp_path / name).write_text(text)
    got = {r.name: (r.content and bytes(r.content), r.error) for r in read_outputs(spark, str(tmp_path)).collect()}
    assert got == {"result.jsonl": (b"{}\n", None), "receipt.json": (None, "reserved_name"), "a b+c": (b"x", None)}


def test_pages_end_with_a_short_one(spark):
    rows = [("c", 1, [1, 2]), ("c", 2, [3]), ("c", 3, [4, 5]), ("d", 1, [6, 7]), (None, 1, [])]
    got = sorted((r.c, r.item) for r in paged(spark.createDataFrame(rows, "c string, page int, items array<int>"), "c", "page", "items", 2).collect())
    assert got == [("c", 1), ("c", 2), ("c", 3), ("d", 6), ("d", 7)]
