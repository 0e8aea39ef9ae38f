"""Indexing and selecting structure records: composition histograms, semi joins on key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composition(species: Column) -> Column:
    """Element counts of an array, keys in order; computed in the row, without a shuffle."""
    elements = F.array_sort(F.array_distinct(species))
    return F.map_from_entries(F.transform(elements, lambda e: F.struct(e.alias("key"), F.size(F.filter(species, lambda x: x == e)).cast("long").alias("value"))))


def structure_index(rows: DataFrame, line: str = "line") -> DataFrame:
    """id, source_line (the row's own, else its physical line), source_index, natoms, composition; nothing else."""
    own = F.col("source_line") if "source_line" in rows.columns else F.lit(None).cast("long")
    index = F.col("source_index") if "source_index" in rows.columns else F.lit(None).cast("long")
    return rows.select("id", F.coalesce(own, F.col(line)).alias("source_line"), index.alias("source_index"), F.size("species").cast("long").alias("natoms"), composition(F.col("species")).alias("composition"))


def select_records(rows: DataFrame, ids: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Records whose id is in ``ids`` or whose line is in ``lines`` (one column each); both absent: all."""
    if ids is None and lines is None:
        return rows
    marks, out = [], rows
    for keys, column, mark in ((ids, "id", "_by_id"), (lines, "source_line", "_by_line")):
        if keys is not None:
            wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct().withColumn(mark, F.lit(True))
            out = out.join(wanted, column, "left")
            marks.append(F.coalesce(F.col(mark), F.lit(False)))
    return out.where(marks[0] if len(marks) == 1 else marks[0] | marks[1]).select(*rows.columns)


def missing_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Requested keys that no record has."""
    wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return wanted.join(rows, column, "left_anti")


def write_selection(rows: DataFrame, path: str, ids: DataFrame | None = None, lines: DataFrame | None = None) -> None:
    """Copy the raw lines of selected records to a new folder; a missing key stops it before any output."""
    for keys, column in ((ids, "id"), (lines, "source_line")):
        if keys is not None and not missing_keys(rows, keys, column).isEmpty():
            raise ValueError("requested records missing from this file")
    select_records(rows, ids, lines).orderBy("line").select("raw").write.mode("errorifexists").text(path)


def write_index(rows: DataFrame, path: str) -> None:
    """The index as JSON lines in a new folder; an existing one is an error."""
    structure_index(rows).write.mode("errorifexists").json(path)
