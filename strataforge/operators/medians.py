"""Exact medians of groups of any size, and rows compared with the row before in logs of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.store import written

#: Rows of a group up to which its values are sorted in one task.
SMALL = 1 << 20
#: Numbers of lines that one task compares.
STRETCH = 1 << 20


def medians(rows: DataFrame, by: str, value: str, out: str = "median", *, small: int = SMALL) -> DataFrame:
    """(by, out): the exact median of each group's values that aren't null (the mean of the two middle ones of an even count).

    Groups of more than ``small`` rows are selected from: their distinct values are counted with partial sums, sorted by
    group and value over range partitions and written; counts by partition tell which one or two hold the middle ranks, and
    only there values are added up one by one. A null key is a group; NaN is larger than any number.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_value")).where("_value is not null")
    large = [r._by for r in rows.groupBy("_by").count().where(F.col("count") > small).select("_by").collect()]  # fewer than rows / small
    if not large:
        return rows.groupBy("_by").agg(F.median("_value").alias(out)).withColumnRenamed("_by", by)
    hot = F.coalesce(F.col("_by").isin([x for x in large if x is not None]), F.lit(None in large))
    few = rows.where(~hot).groupBy("_by").agg(F.median("_value").alias(out))
    return few.union(_selected(spark, rows.where(hot), out)).withColumnRenamed("_by", by)


def _selected(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    counted = rows.groupBy("_by", "_value").agg(F.count("*").alias("_n"))
    placed = counted.repartitionByRange("_by", "_value").withColumn("_part", F.spark_partition_id())
    values = written(placed, "values")
    parts = values.groupBy("_by", "_part").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_by").orderBy("_part")  # a row per range partition
    ranks = parts.select("_by", "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_base"), "_n", F.sum("_n").over(Window.partitionBy("_by")).alias("_all"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    holds = lambda rank: (rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_n"))
    middle = ranks.where(holds(low) | holds(high)).select(F.col("_by").alias("_key"), F.col("_part").alias("_place"), "_base", "_all")
    near = values.join(F.broadcast(middle), F.col("_by").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_place")))  # two rows per large group
    upto = F.sum("_n").over(Window.partitionBy("_by", "_part").orderBy("_value")) + F.col("_base")
    near = near.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    covers = lambda rank: (rank >= F.col("_from")) & (rank < F.col("_upto"))
    one = lambda rank: F.max(F.when(covers(rank), F.col("_value")))
    return near.groupBy("_by").agg(one(low).alias("_low"), one(high).alias("_high")).select("_by", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2).alias(out))


def with_row_before(rows: DataFrame, by: str, line: str, columns: list[str], *, stretch: int = STRETCH, prefix: str = "_before_") -> DataFrame:
    """``rows`` with ``columns`` of the row before it in its group, by ``line`` (whole numbers).

    A group is cut into stretches of line numbers that tasks compare; the last row of each stretch, found with partial
    aggregation, goes to the next one that has rows. A group takes one row per stretch, not its rows, in one task.
    """
    cut = rows.withColumn("_cut", F.expr(f"(`{line}` - pmod(`{line}`, {stretch})) div {stretch}"))
    here = Window.partitionBy(by, "_cut").orderBy(line)
    packed = F.struct(*(F.col(c) for c in columns))
    edges = cut.groupBy(by, "_cut").agg(F.max(F.struct(F.col(line).alias("_line"), packed.alias("_row"))).alias("_last"))
    edges = edges.select(F.col(by).alias("_key"), F.col("_cut").alias("_next"), F.lag("_last._row").over(Window.partitionBy(by).orderBy("_cut")).alias("_edge"))
    met = cut.withColumn("_own", F.lag(packed).over(here)).join(edges, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_cut") == F.col("_next")), "left")
    before = F.coalesce("_own", "_edge")
    return met.select(*rows.columns, *(before.getField(c).alias(prefix + c) for c in columns))

