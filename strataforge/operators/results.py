"""Verdicts on result logs: the first bad line decides, records before it count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions import blank, json_kind, strict_json


def line_error(raw: Column) -> Column:
    """What is wrong with one result line, or null."""
    return F.when(blank(raw), "blank_line").when(~strict_json(raw), "invalid_json").when(json_kind(F.try_parse_json(raw)) != "object", "non_object_row")


def result_verdicts(lines: DataFrame, files: DataFrame, by: str = "file") -> DataFrame:
    """(file, status, reason, records, line) for every row of ``files`` (file, size or null, expected_rows).

    ``lines`` holds (file, line, raw). A null size is a missing file, zero an empty one. Each file
    takes one aggregation, combined before the shuffle.
    """
    checked = lines.select(by, "line", line_error(F.col("raw")).alias("error"))
    per = checked.groupBy(by).agg(F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("bad"), F.count("*").alias("lines"))
    out = files.join(per, by, "left")
    bad, lines_ = F.col("bad"), F.coalesce("lines", F.lit(0))
    records = F.when(bad.isNotNull(), F.col("bad.line") - 1).otherwise(lines_)
    mismatch = (F.col("expected_rows") >= 0) & (records != F.col("expected_rows"))
    reason = F.when(F.col("size").isNull(), None).when((F.col("size") <= 0) | (lines_ == 0), "empty").when(bad.isNotNull(), F.col("bad.error")).when(mismatch, "row_count_mismatch")
    status = F.when(F.col("size").isNull(), "missing").when(reason.isNotNull(), "invalid").otherwise("valid")
    return out.select(by, status.alias("status"), reason.alias("reason"), records.cast("long").alias("records"), F.col("bad.line").alias("line"))


def require_valid(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (status, reason) unchanged; reading a row that isn't valid raises its reason."""
    wrong = F.concat(F.lit("invalid result: "), F.coalesce("reason", "status"))
    return verdicts.withColumn("status", F.when(F.col("status") == "valid", F.col("status")).otherwise(F.raise_error(wrong).cast("string")))


def public_status(executions: DataFrame) -> DataFrame:
    """Executions (child_exit_code, timed_out, output_limit_exceeded, stdout, stderr as bytes or text) without their output: counts and hashes of bytes."""
    streams = {f"{x}_{n}": f(x) for x in ("stdout", "stderr") for n, f in (("bytes", lambda c: F.octet_length(c).cast("long")), ("sha256", lambda c: F.sha2(c, 256)))}
    return executions.withColumns({"schema": F.lit("restricted-exec-status/1"), **streams}).drop("stdout", "stderr")


def limited_output(chunks: DataFrame, by: str, order: str, data: str, limit: int, *, stretch: int = 1 << 20) -> DataFrame:
    """(by, order, data, exceeded) of streams given in chunks: their first ``limit`` bytes, cut exactly, and whether more came.

    A chunk behind the limit is left out; a stream's first chunk stays, be it empty. ``order`` numbers a stream's chunks. Streams are
    summed by stretches of those numbers, so that one of any length takes a row per stretch, not its chunks, in one task.
    """
    c, size = F.col, F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    cut = chunks.select(by, order, c(data).cast("binary").alias("_data"), size.alias("_size"), F.expr(f"(`{order}` - pmod(`{order}`, {stretch})) div {stretch}").alias("_cut"))
    sums = cut.groupBy(by, "_cut").agg(F.sum("_size").alias("_sum"), F.min(order).alias("_first"))
    upto = Window.partitionBy(by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    bases = sums.select(c(by).alias("_by"), c("_cut").alias("_place"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"), (F.sum("_sum").over(whole) > limit).alias("exceeded"), F.min("_first").over(whole).alias("_start"))
    within = Window.partitionBy(by, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(bases, c(by).eqNullSafe(c("_by")) & (c("_cut") == c("_place")))
    left = F.lit(limit) - c("_base") - c("_before")
    kept = F.expr("substring(_data, 1, cast(_left as int))")
    return met.withColumn("_left", F.least(F.greatest(left, F.lit(0)), c("_size"))).where((c("_left") > 0) | (c(order) == c("_start"))).select(by, order, kept.alias(data), "exceeded")
