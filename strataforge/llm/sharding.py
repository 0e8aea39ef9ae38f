"""Proportional stratified interleaving: every shard gets the mixture of the sources.

Built-in DataFrame functions only. Rows are shuffled by a seeded hash within their source and
ranked there; the fractional rank (rank + 1/2) / n orders all sources together, and equal cuts of
that order are the shards. Ranks come from range partitions (see ``range_positions``), so a source
with a third of all rows, or one text with a third of them, is spread over many tasks.

The shuffle hashes the text first, so equal texts of a source are neighbours and all but those
astride a cut share a shard. Defined cases: a null text has no bytes and the checksum of an empty
one; a null source is a source of its own; rows that repeat are rows of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.store import RID, P, identified, is_scan, materialize, range_positions


def stratified_shards(docs: DataFrame, shards: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, scan: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, text_crc32, shard and slot (0, 1, ... in each shard).

    Shards' row counts differ by one at most, and a shard's count of any source differs from its
    share by less than two.
    """
    scan = is_scan(docs) if scan is None else scan
    rows = identified(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *(["_metadata"] if scan else [])), "doc_id", "text", "source", scan=scan
    ).select(
        "doc_id",
        "source",
        *RID,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "text").alias(f"{P}shuffle"),
        F.xxhash64(F.lit(seed), *RID).alias(f"{P}tie"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(f"{P}source"),
    )
    ranked = range_positions(rows, [f"{P}source", f"{P}shuffle", f"{P}tie"], "ranks")
    strata = materialize(ranked.groupBy(f"{P}source").agg(F.min(f"{P}pos").alias(f"{P}first"), F.count("*").alias(f"{P}n")), "strata")
    fraction = (F.col(f"{P}pos") - F.col(f"{P}first") + 0.5) / F.col(f"{P}n")
    mixed = ranked.join(strata, f"{P}source").select("doc_id", "source", *RID, "size", "text_crc32", f"{P}tie", fraction.alias(f"{P}fraction"), F.xxhash64(f"{P}source").alias(f"{P}stratum"))
    placed = range_positions(mixed, [f"{P}fraction", f"{P}stratum", f"{P}tie"], "mixed")
    total = max(placed.count(), 1)
    shard = F.floor(F.col(f"{P}pos") * shards / F.lit(total)) if total * shards < 2**52 else F.expr(f"{P}pos * {shards} div {total}")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(f"{P}pos") - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot", *RID)


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, *, columns: list[str] | None = None) -> None:
    """Write the rows of the file scan ``docs`` as one folder per shard, in slot order within files."""
    rows = docs.select(*(columns or docs.columns), "_metadata")
    rows = rows.withColumns({RID[0]: F.xxhash64(F.col("_metadata.file_path")), RID[1]: F.col("_metadata.row_index")}).drop("_metadata")
    out = rows.join(assignment.select(*RID, F.col("shard").alias(f"{P}shard"), F.col("slot").alias(f"{P}slot")), RID).drop(*RID)
    out.repartitionByRange(f"{P}shard", f"{P}slot").sortWithinPartitions(f"{P}shard", f"{P}slot").drop(f"{P}slot").write.partitionBy(f"{P}shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 whose row counts are at most one apart."""
    out = stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24, scan=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
