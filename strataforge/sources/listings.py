"""Saved listings in pages as a data source, and sinks of which nothing shows unless all tasks have ended."""

from __future__ import annotations

from collections.abc import Iterator
import json
import posixpath
from typing import NamedTuple
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strataforge.sources import paged

#: Pages that one task reads.
RUN = 64


class _Pages(InputPartition):
    def __init__(self, group: str, pages: list[tuple[int, str]]) -> None:
        super().__init__((group, pages))


class PagedListing(DataSource):
    """``format("paged_listing")``: a folder of groups, each a folder of files ``<page>.json`` that hold ``{"sha": ..., "files": [...]}``.

    A row per page: group, page, items (each as JSON) and error, where the page is another group's or has no list of files.
    Tasks read ``RUN`` pages of one group each, and none beyond the first page of theirs that isn't full (option ``full``, 100).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "group string, page int, items array<string>, error string"

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return _PagedReader(self.options["path"], int(self.options.get("full", 100)))


class _PagedReader(DataSourceReader):
    def __init__(self, path: str, full: int) -> None:
        self.path, self.full = path, full

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        groups: dict[str, list[tuple[int, str]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            stem, suffix = posixpath.splitext(info.base_name)
            if info.type == fs.FileType.File and suffix == ".json" and stem.isdigit():
                groups.setdefault(posixpath.basename(posixpath.dirname(info.path)), []).append((int(stem), info.path))
        return [_Pages(group, sorted(pages)[k : k + RUN]) for group, pages in sorted(groups.items()) for k in range(0, len(pages), RUN)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        group, pages = partition.value
        for page, path in pages:
            with store.open_input_file(path) as file:
                found = json.loads(file.read())
            error, items = None, None
            # Fixed values of the format.
            if not isinstance(found, dict) or found.get("sha") != group:
                error = "invalid_base_source_commit"
            elif not isinstance(found.get("files"), list):
                error = "base_source_commit_files_missing"
            else:
                items = [json.dumps(x, sort_keys=True, separators=(",", ":")) for x in found["files"]]
            yield group, page, items, error
            if error or len(items) < self.full:
                return


def read_paged(spark: SparkSession, path: str, full: int = 100) -> DataFrame:
    """(group, page, position, item, error) of saved listings: pages count up to the first that isn't full; of one that is wrong there is only the error."""
    spark.dataSource.register(PagedListing)
    pages = spark.read.format("paged_listing").option("full", full).load(path)
    wrong = pages.where("error is not null").groupBy("group").agg(F.min("page").alias("_bad"))
    whole = paged(pages.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), "group", "page", "items", full)
    ends = pages.where(F.size("items") < full).groupBy("group").agg(F.min("page").alias("_end"))
    bad = pages.where("error is not null").join(wrong, "group").join(ends, "group", "left").where((F.col("page") == F.col("_bad")) & (F.col("_end").isNull() | (F.col("_bad") < F.col("_end"))))
    good = whole.join(bad.select("group").distinct(), "group", "left_anti").select("group", "page", "position", "item", F.lit(None).cast("string").alias("error"))
    return good.union(bad.select("group", "page", F.lit(None).cast("int"), F.lit(None).cast("string"), "error"))


class _Part(NamedTuple):
    number: int
    name: str | None
    rows: int


class Written(WriterCommitMessage):
    """A task's part: where it lies until the job commits, and how many lines it holds."""

    def __init__(self, part: _Part) -> None:
        self.part = part


class WholeLines(DataSource):
    """``format("whole_lines")``: writes (number long, raw binary or string) as files of exact lines, each as it is with its line end.

    Tasks write below ``_parts``; the job's commit moves what they report into place and leaves a list of parts and counts in
    ``_lines.json``; an abort removes it all. A folder that exists is refused.
    """

    @classmethod
    def name(cls) -> str:
        return "whole_lines"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002
        return _LinesWriter(self.options["path"])


class _LinesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        store, root = fs.FileSystem.from_uri(path)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.path)
        number, rows, stream = TaskContext.get().partitionId(), 0, None
        name = f"{root}/_parts/{number:08d}-{uuid.uuid4().hex}"  # a repeated attempt writes a file of its own
        try:
            for row in iterator:
                if stream is None:
                    store.create_dir(f"{root}/_parts", recursive=True)
                    stream = store.open_output_stream(name)
                raw = row.raw
                stream.write(raw.encode() if isinstance(raw, str) else bytes(raw))
                rows += 1
        finally:
            if stream is not None:
                stream.close()
        return Written(_Part(number, name if stream is not None else None, rows))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        parts = sorted(m.part for m in messages if m is not None and m.part.name)
        for p in parts:
            store.move(p.name, f"{root}/part-{p.number:08d}")
        if store.get_file_info(f"{root}/_parts").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_parts")
        with store.open_output_stream(f"{root}/_lines.json") as file:
            file.write(json.dumps({"parts": [[f"part-{p.number:08d}", p.rows] for p in parts]}).encode())

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def write_lines(rows: DataFrame, path: str, order: str, raw: str = "raw") -> None:
    """``rows`` in the order of ``order`` as exact lines: the parts of the folder, one after another, are the copy. All of it, or nothing."""
    spark = rows.sparkSession
    spark.dataSource.register(WholeLines)
    ordered = rows.select(F.col(order).cast("long").alias("number"), F.col(raw).cast("binary").alias("raw")).repartitionByRange("number").sortWithinPartitions("number")
    ordered.write.format("whole_lines").mode("append").save(path)
