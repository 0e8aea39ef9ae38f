"""Runs and attempts: the newest attempt, completion, identity of receipts, create-only appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_attempts(attempts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the row whose ``order`` columns, as numbers from the first on, are largest.

    One aggregation, combined before the shuffle; ties fall to the remaining columns.
    """
    rest = [c for c in attempts.columns if c not in (*by, *order)]
    top = attempts.groupBy(*by).agg(F.max(F.struct(*(F.col(c).cast("long").alias(f"_{c}") for c in order), *order, *rest)).alias("t"))
    return top.select(*by, *(F.col(f"t.{c}").alias(c) for c in (*order, *rest)))


def completed(stage: Column, exit_code: Column, timed_out: Column, output_limit_exceeded: Column, rows: Column, result_status: Column, metadata_errors: Column, collection_errors: Column) -> Column:
    """Whether a run counts as done: all eight conditions, unknown counting as not met or no fault."""
    no = lambda flag: ~F.coalesce(flag, F.lit(False))
    none = lambda errors: F.coalesce(errors, F.lit(0)) == 0
    sure = (stage == "materialized") & (exit_code == 0) & (rows > 0) & (result_status == "valid")
    return F.coalesce(sure, F.lit(False)) & no(timed_out) & no(output_limit_exceeded) & none(metadata_errors) & none(collection_errors)


#: Rows of a key's slice: two slices that meet make the square of it in pairs.
SLICE = 2048


def identity_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides that agree in every identity column, nulls equal to nulls.

    A key with many rows is cut into slices on both sides, and each two slices that meet are a tile of their own: tasks get
    tiles, not keys, and their number grows with the pairs. One small job counts the tiles.
    """
    spark = left.sparkSession
    kinds = dict(left.select(*on).union(right.select(*on)).dtypes)
    key = F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in on)).alias("_key")  # one value, never null, so that nulls meet nulls
    counted = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0), F.lit(1)))
    slices = lambda n: F.ceil(F.sum(n) / SLICE).cast("int")
    keys = counted.groupBy("_key").agg(slices("l").alias("_a"), slices("r").alias("_b"))
    tiles = keys.agg(F.sum(F.col("_a").cast("long") * F.col("_b"))).first()[0] or 0
    large = F.broadcast(keys.where("_a > 1 or _b > 1"))  # a row in SLICE at most
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles // 8)

    def tiled(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row's own slice follows from the row; it goes to each slice of the other side."""
        cut = rows.withColumns({"_key": key, "_own": F.xxhash64(*rows.columns)}).join(large.select("_key", own, other), "_key", "left")
        cut = cut.withColumns({own: F.coalesce(F.pmod("_own", own), F.lit(0)), other: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1))})
        # a given number of partitions isn't coalesced by their bytes, which say nothing of the pairs
        return cut.select(F.struct("_key", F.col("_a").cast("long").alias("a"), F.col("_b").cast("long").alias("b")).alias("_tile"), *rows.columns).repartition(n, "_tile")

    rest = [c for c in right.columns if c not in on]
    return tiled(left, "_a", "_b").join(tiled(right, "_b", "_a").select("_tile", *rest), "_tile").select(*left.columns, *rest)


def outside_delivery(changes: DataFrame, delivered: DataFrame, path: str) -> DataFrame:
    """Changed paths that no delivered file accounts for, or that were removed; none: the snapshot is clean."""
    return changes.join(delivered.select(path).distinct().withColumn("_in", F.lit(True)), path, "left").where(F.col("_in").isNull() | F.coalesce(F.col("status") == "removed", F.lit(False))).drop("_in")


def create_only(existing: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome) of incoming rows: same (nothing to do), conflict (refused) or create.

    A key that comes with several contents is a conflict whatever exists.
    """
    held = existing.select(key, F.col(value).alias("_held"), F.lit(True).alias("_there"))
    several = (F.count_if(F.col(value).isNull()) > 0).cast("int") + F.when(F.min(value) < F.max(value), 2).when(F.min(value).isNotNull(), 1).otherwise(0) > 1
    per = incoming.groupBy(F.col(key).alias("_key")).agg(several.alias("_several"))
    outcome = F.when(F.col("_several"), "conflict").when(F.col("_there").isNull(), "create").when(F.col("_held").eqNullSafe(F.col(value)), "same").otherwise("conflict")
    rows = incoming.select(key, value).join(per, F.col(key).eqNullSafe(F.col("_key"))).join(held, key, "left")
    return rows.select(key, value, outcome.alias("outcome"))


def append_create_only(existing: DataFrame, incoming: DataFrame, key: str, value: str, path: str) -> None:
    """Append the rows to create below ``path``, each once; any conflict refuses all of them."""
    decided = create_only(existing, incoming, key, value)
    if not decided.where("outcome = 'conflict'").isEmpty():
        raise ValueError("a path exists with other content")
    decided.where("outcome = 'create'").select(key, value).distinct().write.mode("append").parquet(path)
