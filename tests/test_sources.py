"""Folders with entries that can't be read, listings in pages, and copies that are whole or not there."""

import json

import pytest
from pyspark.sql import functions as F

from strataforge.sources import listings, paged, read_outputs
from strataforge.sources.listings import read_paged, write_lines


def test_folder_with_bad_entries(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "a b+c%20é.txt").write_bytes(b"\x00\xff")
    (folder / ".hidden").write_bytes(b"h")
    (folder / "empty").write_bytes(b"")
    (folder / "receipt.json").write_bytes(b"{}")
    (folder / "folder").mkdir()
    got = {r.name: (r.error, None if r.content is None else bytes(r.content)) for r in read_outputs(spark, f"file://{folder}").collect()}
    assert got == {"a b+c%20é.txt": (None, b"\x00\xff"), ".hidden": (None, b"h"), "empty": (None, b""), "receipt.json": ("reserved_name", None), "folder": ("not_regular_file", None)}
    assert read_outputs(spark, f"file://{tmp_path}/absent").count() == 0
    (tmp_path / "file").write_text("x")
    assert [tuple(r) for r in read_outputs(spark, f"file://{tmp_path}/file").collect()] == [(None, None, "output_directory_unreadable")]


def test_an_entry_that_goes_before_it_is_read(spark, tmp_path):
    (tmp_path / "gone").write_bytes(b"x")
    (tmp_path / "grown").write_bytes(b"x")
    (tmp_path / "good").write_bytes(b"x")
    rows = read_outputs(spark, f"file://{tmp_path}")
    (tmp_path / "gone").unlink()
    (tmp_path / "grown").write_bytes(b"xy")
    assert {r.name: r.error for r in rows.collect()} == {"gone": "read_failed", "grown": "changed_during_collection", "good": None}


def test_paged_listings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listings, "RUN", 2)
    sizes = {"a" * 40: [3, 3, 2, 3], "b" * 40: [3, 3, 3], "c" * 40: [0], "d" * 40: [3, 3, 3, 3, 1, 3, 3]}
    for group, counts in sizes.items():
        (tmp_path / group).mkdir()
        for k, n in enumerate(counts, 1):
            (tmp_path / group / f"{k}.json").write_text(json.dumps({"sha": group, "files": [{"filename": f"{k}-{x}"} for x in range(n)]}))
    for group, pages in {"e" * 40: [{"sha": "other", "files": []}], "f" * 40: [{"sha": "f" * 40, "files": [1, 2, 3]}, {"sha": "f" * 40}], "0" * 40: [{"sha": "0" * 40, "files": [1]}, {"sha": "x"}]}.items():
        (tmp_path / group).mkdir()
        for k, page in enumerate(pages, 1):
            (tmp_path / group / f"{k}.json").write_text(json.dumps(page))
    found = read_paged(spark, f"file://{tmp_path}", 3).collect()
    assert {r.group[0]: (r.page, r.error) for r in found if r.error} == {"e": (1, "invalid_base_source_commit"), "f": (2, "base_source_commit_files_missing")}
    rows = spark.createDataFrame([(g, k, [f'{{"filename":"{k}-{x}"}}' for x in range(n)]) for g, c in sizes.items() for k, n in enumerate(c, 1)] + [("0" * 40, 1, ["1"])], "group string, page int, items array<string>")
    want = {tuple(r) for r in paged(rows, "group", "page", "items", 3).collect()}
    assert {(r.group, r.page, r.position, r.item) for r in found if not r.error} == want


def test_whole_lines(spark, tmp_path):
    lines = [f"{k}é\r\n" if k % 3 else f"{k}" for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, raw string").repartition(5)
    path = f"file://{tmp_path}/copy"
    write_lines(rows, path, "n")
    parts = json.loads((tmp_path / "copy/_lines.json").read_text())["parts"]
    assert b"".join((tmp_path / "copy" / name).read_bytes() for name, _ in parts) == "".join(lines).encode() and sum(n for _, n in parts) == 300
    assert not (tmp_path / "copy/_parts").exists()
    with pytest.raises(Exception, match="exists"):
        write_lines(rows, path, "n")
    write_lines(rows.limit(0), f"file://{tmp_path}/none", "n")
    assert json.loads((tmp_path / "none/_lines.json").read_text()) == {"parts": []}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("n"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.lit("x\n")).alias("raw"))
    with pytest.raises(Exception, match="broken"):
        write_lines(rows, f"file://{tmp_path}/copy", "n")
    assert not (tmp_path / "copy").exists()
