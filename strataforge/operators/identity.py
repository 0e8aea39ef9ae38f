"""Content identity: manifests, duplicate names, hash assertions, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import content_sha256


def file_manifest(files: DataFrame, by: str, name: str, content: str) -> DataFrame:
    """(group, n_files, total_bytes, manifest): a map name -> SHA-256 with its names in order.

    Suited to small groups of files that belong together: a group's map is one value, and a name
    may not repeat in it. ``manifest_rows`` has neither limit.
    """
    size = F.octet_length(content) if dict(files.dtypes)[content] == "string" else F.length(content)
    entry = F.struct(F.col(name).alias("key"), content_sha256(F.col(content)).alias("value"))
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("total_bytes"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("manifest"))


def manifest_rows(files: DataFrame, by: str, name: str, content: str) -> DataFrame:
    """(group, name, digest, n_files, total_bytes), a row per file; groups of any size, repeated and null names included."""
    size = F.octet_length(content) if dict(files.dtypes)[content] == "string" else F.length(content)
    totals = files.groupBy(F.col(by).alias("_group")).agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("total_bytes"))
    rows = files.select(by, F.col(name).alias("name"), content_sha256(F.col(content)).alias("digest"))
    return rows.join(totals, F.col(by).eqNullSafe(F.col("_group"))).drop("_group")


def wheel_rows(folders: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """(group, error, wheel_count, wheel_bytes, manifest_sha256) of folders of wheels: ``folders`` names them, ``files`` (group, name, regular, content) has what is in them.

    An empty folder is an error, and so is an entry that is no regular file or has another suffix. The digest covers names and
    hashes in the order of names; it is made from the sums of their row hashes, so that no folder is gathered in one value.
    """
    odd = ~F.coalesce(F.col("regular") & F.lower("name").endswith(".whl") & (F.length("name") > 4), F.lit(False))
    row = [F.sum(F.xxhash64(F.lit(seed), "name", content_sha256(F.col("content"))).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    per = files.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.max(odd.cast("int")).alias("odd"), F.sha2(F.concat_ws("-", *row), 256).alias("digest"))
    error = F.when(F.coalesce("n", F.lit(0)) == 0, "wheelhouse is empty").when(F.col("odd") == 1, "wheelhouse contains a non-wheel entry")
    good = lambda name, out: F.when(F.col("error").isNull(), F.col(name)).alias(out)
    return folders.select(by).join(per, by, "left").withColumn("error", error).select(by, "error", good("n", "wheel_count"), good("bytes", "wheel_bytes"), good("digest", "manifest_sha256"))


def installed_errors(pins: DataFrame, installed: DataFrame, by: str = "file") -> DataFrame:
    """(by, name, problem) where a pinned distribution (by, normalized, version) isn't installed (by, normalized, version) or has another version."""
    have = installed.groupBy(by, "normalized").agg(F.min("version").alias("_have"))
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("version"), "version_mismatch")
    return pins.join(have, [by, "normalized"], "left").select(by, F.col("normalized").alias("name"), problem.alias("problem")).where("problem is not null")


def duplicate_names(rows: DataFrame, name: str) -> DataFrame:
    """(normalized, copies) of names that coincide once case and underscores are set aside."""
    return rows.groupBy(F.translate(F.lower(name), "_", "-").alias("normalized")).agg(F.count("*").alias("copies")).where("copies > 1")


def identity_mismatches(declared: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem) where a declared file is missing, undeclared or has another digest; none: they agree."""
    both = declared.select(key, F.col(digest).alias("want")).join(actual.select(key, F.col(digest).alias("have")), key, "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when(F.col("want") != F.col("have"), "hash_mismatch")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def disjoint(left: Column, right: Column) -> Column:
    """Two arrays share nothing (nulls aside)."""
    return F.size(F.array_intersect(left, right)) == 0


def set_equal(left: Column, right: Column) -> Column:
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def no_repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)
