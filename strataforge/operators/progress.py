"""Progress logs: row rules, monotony against the row before, prefix semantics, time-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import blank, clamp, field, finite_nonnegative, json_kind, strict_json
from strataforge.operators.medians import medians, with_row_before

#: The schema tag that a progress record carries.
TAG = "descriptor-progress/1"


def parsed_progress(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line, raw, terminated) with the typed fields and the first row rule broken."""
    v = F.col("_v")  # parsed once
    number = lambda name: F.when(json_kind(field(v, name)).isin("int", "real"), F.try_variant_get(v, f"$.{name}", "double"))
    whole = lambda name: F.when(json_kind(field(v, name)) == "int", F.try_variant_get(v, f"$.{name}", "bigint"))
    string = lambda name: F.when(json_kind(field(v, name)) == "string", F.try_variant_get(v, f"$.{name}", "string"))
    given = lambda name: F.coalesce(json_kind(field(v, name)), F.lit("null")) != "null"
    fields = {"processed": whole("processed"), "total": whole("total"), "elapsed_seconds": number("elapsed_seconds"), "last_id": string("last_id"), "item_seconds": number("item_seconds"), "phase": string("phase")}
    c = F.col
    error = (
        F.when(blank(c("raw")), "blank_line")
        .when(~strict_json(c("raw")), "invalid_json")
        .when((json_kind(v) != "object") | ~F.coalesce(string("schema") == TAG, F.lit(False)), "invalid_progress_record")
        .when(~F.coalesce(c("processed") >= 0, F.lit(False)), "invalid_processed")
        .when(given("total") & ~F.coalesce((c("total") >= c("processed")) & (c("total") >= 0), F.lit(False)), "invalid_total")
        .when(~finite_nonnegative(c("elapsed_seconds")), "invalid_elapsed")
        .when(given("last_id") & c("last_id").isNull(), "invalid_last_id")
        .when(given("item_seconds") & ~finite_nonnegative(c("item_seconds")), "invalid_item_seconds")
        .when(given("phase") & c("phase").isNull(), "invalid_phase")
    )
    return lines.withColumn("_v", F.try_parse_json("raw")).withColumns(fields).withColumn("error", error).drop("_v")


def monotony_errors(rows: DataFrame, by: str = "file", line: str = "line") -> DataFrame:
    """``rows`` with nonmonotonic_progress where processed or elapsed_seconds falls below the row before."""
    known = with_row_before(rows, by, line, ["processed", "elapsed_seconds"])
    falls = (F.col("processed") < F.col("_before_processed")) | (F.col("elapsed_seconds") < F.col("_before_elapsed_seconds"))
    error = F.coalesce("error", F.when(F.coalesce(falls, F.lit(False)), "nonmonotonic_progress"))
    return known.withColumn("error", error).select(*rows.columns)


def progress_summary(rows: DataFrame, by: str = "file", line: str = "line", files: DataFrame | None = None) -> DataFrame:
    """Per log: the first error, and over the valid rows before it the counts, last fields, median and slowest item.

    The first of equally slow items is the slowest. A final line that is no JSON and has no line end
    is a truncated one, not an error. ``files`` (file, size) adds logs without rows: missing where
    the size is null, else invalid, ``empty`` or without valid records.
    """
    bad = F.min(F.when(F.col("error").isNotNull(), F.struct(F.col(line).alias("line"), F.col("error").alias("error"), F.col("terminated").alias("terminated"))))
    firsts = rows.groupBy(by).agg(bad.alias("bad"), F.max(line).alias("last_line"))
    valid = rows.join(firsts, by).where(F.col("bad").isNull() | (F.col(line) < F.col("bad.line")))
    item = F.when(F.col("item_seconds").isNotNull(), F.struct(F.col("item_seconds").alias("s"), (-F.col(line)).alias("n"), F.col("last_id").alias("i")))
    tail = F.max(F.struct(F.col(line).alias("n"), "processed", "total", "elapsed_seconds", "last_id", "item_seconds", "phase"))
    per = valid.groupBy(by).agg(F.count("*").alias("records"), tail.alias("last"), F.count("item_seconds").alias("timed_items"), F.max(item).alias("slow"))
    middle = medians(valid, by, "item_seconds", "median_item_seconds")
    out = firsts.join(per, by, "left").join(middle, by, "left")
    if files is not None:
        out = files.select(by, F.col("size").alias("_size"), F.lit(True).alias("_listed")).join(out, by, "full_outer")
    else:
        out = out.withColumns({"_size": F.lit(1), "_listed": F.lit(False)})
    absent = F.coalesce(F.col("_listed") & F.col("_size").isNull(), F.lit(False))
    bare = ~absent & (F.coalesce(F.col("_size") <= 0, F.lit(False)) | F.col("last_line").isNull())
    records = F.coalesce("records", F.lit(0))
    truncated = F.coalesce((F.col("bad.error") == "invalid_json") & (F.col("bad.line") == F.col("last_line")) & ~F.col("bad.terminated"), F.lit(False))
    failed = F.col("bad").isNotNull() & ~truncated
    status = F.when(absent, "missing").when(failed | bare, "invalid").when(truncated, "partial").otherwise("valid")
    reason = F.when(absent, None).when(bare, F.when(F.col("_size") > 0, "no_valid_records").otherwise("empty")).when(failed, F.col("bad.error")).when(truncated & (records == 0), "truncated_final_line")
    clear = lambda c: F.when(~failed, c)
    last = {n: clear(F.col(f"last.{f}")).alias(n) for n, f in (("processed", "processed"), ("total", "total"), ("reported_elapsed_seconds", "elapsed_seconds"), ("last_id", "last_id"), ("last_item_seconds", "item_seconds"), ("phase", "phase"))}
    return out.select(
        by, status.alias("status"), reason.alias("reason"), records.alias("records"), F.when(failed, F.col("bad.line")).alias("line"), *last.values(), truncated.alias("truncated_final_line"),
        clear(F.coalesce("timed_items", F.lit(0))).alias("timed_items"), clear(F.col("median_item_seconds")).alias("median_item_seconds"), clear(F.col("slow.s")).alias("slowest_item_seconds"), clear(F.col("slow.i")).alias("slowest_id"),
    )


def timeout_pattern(summary: DataFrame) -> DataFrame:
    """``summary`` (status, records, reported_elapsed_seconds, median_item_seconds; timed_out, wall_seconds,
    timeout_budget_seconds) with the gap since the last progress, its threshold and the pattern.

    An invalid log has no pattern, nor has one without records, unless it is missing. Without a
    column ``status`` a log with records is valid and any other missing.
    """
    c = F.col
    wall, budget, median = c("wall_seconds"), c("timeout_budget_seconds"), c("median_item_seconds")
    has_rows, known, out_of_time = F.coalesce(c("records") > 0, F.lit(False)), finite_nonnegative(wall), F.coalesce("timed_out", F.lit(False))
    status = c("status") if "status" in summary.columns else F.when(has_rows, "valid").otherwise("missing")
    usable = status.isin("valid", "partial") & has_rows & c("reported_elapsed_seconds").isNotNull()
    budgeted = finite_nonnegative(budget) & (budget > 0)
    gap = F.when(usable & known, F.greatest(F.lit(0.0), wall - c("reported_elapsed_seconds")))
    # a tenth of the budget and five typical items; without items a quarter of the budget
    floor = F.when(budgeted, clamp(0.10 * budget, F.lit(1.0), F.lit(60.0))).otherwise(60.0)
    untimed = F.when(budgeted, clamp(0.25 * budget, F.lit(2.0), F.lit(120.0))).otherwise(120.0)
    threshold = F.when(gap.isNotNull() & out_of_time, F.when(median.isNotNull(), F.greatest(floor, 5.0 * median)).otherwise(untimed))
    pattern = F.when(
        out_of_time,
        F.when(status == "missing", "timeout_no_progress_records").when(~usable, None).when(~known, "timeout_progress_present_wall_unknown").when(gap >= threshold, "timeout_long_gap_since_progress").otherwise("timeout_recent_progress"),
    )
    return summary.withColumns({"seconds_since_last_progress": gap, "long_gap_threshold_seconds": threshold, "timeout_pattern": pattern})


def method_medians(trials: DataFrame, method: str = "method", seconds: str = "seconds") -> DataFrame:
    """(method, trials, median_seconds): exact medians of timed trials by method."""
    counts = trials.groupBy(F.col(method).alias("_method")).agg(F.count("*").alias("trials"))
    middle = medians(trials, method, seconds, "median_seconds")
    return counts.join(middle, F.col("_method").eqNullSafe(F.col(method)), "left").select(F.col("_method").alias(method), "trials", "median_seconds")
