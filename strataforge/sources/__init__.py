"""Sources that keep what line readers lose: physical line numbers and line ends."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.store import filesystem

#: Line ends: ``bytes`` cuts at \\n only, ``universal`` at \\n, \\r\\n and \\r, ``unicode`` also at
#: vertical tab, form feed, the separators 0x1C to 0x1E, NEL and the two Unicode separators.
SPLITS = {
    "bytes": r"\n",
    "universal": r"\r\n|\n|\r",
    "unicode": r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]",
}


def lines_of(text: Column, split: str = "bytes") -> Column:
    """Structs (line, raw, terminated) of a text; a final line end opens no further line.

    A final line is terminated by a newline (or what text mode makes one), not by a separator.
    """
    whole = text.endswith("\n") | text.endswith("\r") if split != "bytes" else text.endswith("\n")

    def numbered(t: Column) -> Column:
        # bound to a variable, the parts are made once and not for every line again
        count = F.size(t.parts) - F.when(F.element_at(t.parts, -1) == "", 1).otherwise(0)
        return F.slice(F.transform(t.parts, lambda raw, i: F.struct((i + 1).cast("long").alias("line"), raw.alias("raw"), ((i + 1 < count) | t.whole).alias("terminated"))), 1, count)

    bound = F.array(F.struct(F.split(text, SPLITS[split], -1).alias("parts"), whole.alias("whole")))
    return F.when(text.isNotNull(), F.get(F.transform(bound, numbered), F.lit(0)))


def read_lines(spark: SparkSession, path: str, split: str = "bytes", per: str = "file") -> DataFrame:
    """(file, line, raw, terminated) of text files, numbered from 1 in each file (or, with ``per="folder"``, through its folder's files by name).

    Under the rules ``bytes`` and ``universal`` a file is cut wherever Spark cuts it: tasks number the lines of their splits,
    and the splits' counts (a row each) give each split its first number. Under ``unicode`` a file is read whole.
    """
    if split == "unicode":
        if per != "file":
            raise ValueError("the unicode rule numbers each file by itself")
        files = spark.read.format("binaryFile").load(path)
        return files.select(F.col("path").alias("file"), F.explode(lines_of(F.decode("content", "utf-8"), split)).alias("l")).select("file", "l.*")
    # text readers end lines at any of \n, \r\n and \r unless told otherwise
    lines = _split_lines(spark, path, None if split == "universal" else "\n")
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    folder = F.regexp_replace("file", r"[^/]*\z", "")
    group = F.col("file") if per == "file" else folder
    before = Window.partitionBy("group").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    places = splits.withColumn("group", group).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = _line_ends(spark, path, split)
    last = Window.partitionBy("file").orderBy(F.col("start").desc())
    places = places.withColumn("_rank", F.row_number().over(last)).join(ends.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"))
    places = places.select(F.col("file").alias("_name"), F.col("start").alias("_start"), "first", "base", F.when(F.col("_rank") == 1, F.col("last")).alias("final"), "ended")
    met = lines.join(places, (F.col("file") == F.col("_name")) & (F.col("start") == F.col("_start")))
    return met.select("file", (F.col("at") - F.col("first") + F.col("base") + 1).alias("line"), "raw", (F.col("ended") | ~F.coalesce(F.col("at") == F.col("final"), F.lit(False))).alias("terminated"))


def _split_lines(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """(file, start, at, raw): a line, its split's first byte, and a number that grows with the lines of a split."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def _line_ends(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(file, ended): whether the last line of each file has its line end.

    Every line but the last has a newline, so that the bytes of all lines and newlines are the file's, or one more.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").endswith("\r").alias("returned")).alias("line"), (F.octet_length("value") + 1).alias("bytes"))
    per = rows.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.max("line").alias("line"))
    ended = F.col("bytes") == F.col("size")
    return per.select("file", (ended | F.col("line.returned") if split == "universal" else ended).alias("ended"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array, with their ordinal; another root is an error."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "utf-8")
    is_array = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
    checked = F.when(is_array, text).otherwise(F.raise_error(F.lit("input must be a JSON array")))
    rows = files.select(F.posexplode(F.from_json(checked, f"array<{schema}>")).alias("ordinal", "row"))
    return rows.select("ordinal", "row.*")


def read_bounded(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Whole files (file, content) of at most ``limit`` bytes; a larger one is an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.when(F.col("length") <= limit, F.col("content")).otherwise(F.raise_error(F.lit("file too large"))).alias("content"))


#: An exact pin: a name and a version without white space or another equals sign.
PIN = r"(?U)\A([A-Za-z0-9_.\-]+)==([^\s=\x1c-\x1f]+)\z"


def pins(lines: DataFrame, by: str = "file") -> DataFrame:
    """Exact pins ``name==version`` of lock files' lines: (file, line, name, version, normalized, error).

    ``lines`` are cut by the ``unicode`` rule; a file's last line lacks its newline where it isn't terminated.
    """
    name = F.regexp_extract("raw", PIN, 1)
    out = lines.select(by, "line", name.alias("name"), F.regexp_extract("raw", PIN, 2).alias("version"), F.translate(F.lower(name), "_", "-").alias("normalized"), "terminated")
    repeated = out.where("name <> ''").groupBy(by, "normalized").agg(F.min("line").alias("first"))
    error = F.when(F.col("name") == "", "not_exact_pin").when(F.col("line") > F.col("first"), "duplicate_distribution").when(~F.col("terminated"), "missing_final_newline")
    return out.join(repeated, [by, "normalized"], "left").select(by, "line", "name", "version", "normalized", error.alias("error"))


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """``pins`` of the lock files at ``path``."""
    return pins(read_lines(spark, path, "unicode")).drop("file")


def lock_verdicts(locks: DataFrame) -> DataFrame:
    """(file, package_count, sha256, error) of lock files (file, text, expected_sha256, expected_count).

    A missing final newline comes first, then the first bad line, an empty lock, another hash, another count.
    """
    lines = locks.select("file", F.explode(lines_of(F.col("text"), "unicode")).alias("l")).select("file", "l.*")
    per = pins(lines).groupBy("file").agg(F.count("*").alias("lines"), F.min(F.when(F.col("error") != "missing_final_newline", F.struct("line", "error"))).alias("bad"))
    digest = F.sha2("text", 256)
    error = (
        F.when(~F.col("text").endswith("\n") & ~F.col("text").endswith("\r"), "missing_final_newline").when(F.col("bad").isNotNull(), F.col("bad.error")).when(F.coalesce("lines", F.lit(0)) == 0, "empty_lock")
        .when(~digest.eqNullSafe(F.col("expected_sha256")), "lock_hash_mismatch").when(~F.col("lines").eqNullSafe(F.col("expected_count")), "package_count_mismatch")
    )
    return locks.join(per, "file", "left").select("file", F.coalesce("lines", F.lit(0)).alias("package_count"), digest.alias("sha256"), error.alias("error"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, error) of what lies in a folder: exact bytes, or what is wrong with an entry; a row without a name where the folder can't be listed.

    The driver lists names; tasks read the files, each by itself, so that one that can't be read is a row and no failure of
    the job. A folder that isn't there has no rows.
    """
    from strataforge.operators.contracts import collected_name_error

    system, folder = filesystem(spark, path)
    entries, kinds = [], "name string, uri string, regular boolean, size long, changed long"
    try:
        found = system.listStatus(folder) if system.exists(folder) and system.getFileStatus(folder).isDirectory() else None
        if found is None and system.exists(folder):
            return _unreadable(spark)
        for f in found or []:
            entries.append((f.getPath().getName(), f.getPath().toString(), f.isFile() and not f.isSymlink(), f.getLen(), f.getModificationTime()))
    except Py4JJavaError:  # no permission, or it went meanwhile
        return _unreadable(spark)
    listed = spark.createDataFrame(sorted(entries), kinds)
    named = listed.withColumn("error", F.coalesce(collected_name_error(F.col("name")), F.when(~F.col("regular"), "not_regular_file")))
    return named.mapInArrow(_read_entries, "name string, content binary, error string")


def _unreadable(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None, None, "output_directory_unreadable")], "name string, content binary, error string")


def _read_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed files to their bytes: a file at a time, so that a task holds one."""
    for batch in batches:
        for entry in batch.to_pylist():
            content, error = None, entry["error"]
            if error is None:
                try:
                    store, path = fs.FileSystem.from_uri(quote(entry["uri"], safe=":/"))
                    with store.open_input_file(path) as file:
                        content = file.read()
                    if len(content) != entry["size"] or int(store.get_file_info(path).mtime_ns // 1_000_000) != entry["changed"]:
                        content, error = None, "changed_during_collection"
                except OSError:
                    error = "read_failed"
            yield pa.RecordBatch.from_arrays([pa.array([entry["name"]]), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["name", "content", "error"])


def paged(pages: DataFrame, by: str, page: str, items: str, full: int = 100) -> DataFrame:
    """(group, item) of listings dealt in pages: pages count until the first one that isn't full."""
    short = pages.where(F.size(items) < full).groupBy(F.col(by).alias("_by")).agg(F.min(page).alias("_last"))
    seen = pages.join(short, F.col(by).eqNullSafe(F.col("_by")), "left").where(F.col("_last").isNull() | (F.col(page) <= F.col("_last")))
    return seen.select(by, page, F.posexplode(items).alias("position", "item"))


def not_finite(value: Column, kind: T.DataType) -> Column:
    """Whether a value of a type holds NaN or an infinity at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: not_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(value), lambda x: not_finite(x, kind.valueType)), F.lit(False))
    out = F.lit(False)
    for f in kind.fields if isinstance(kind, T.StructType) else ():
        out = out | not_finite(value.getField(f.name), f.dataType)
    return out


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """``rows`` as one JSON array: a folder whose part files, one after another, are its text.

    Rows are sorted by ``order`` (nulls first) over range partitions, so nothing gathers in one task; NaN and
    infinities at any depth are refused, and an existing folder is an error.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    text = F.when(not_finite(whole, rows.schema), F.raise_error(F.lit("numbers must be finite"))).otherwise(F.to_json(whole))
    if rows.isEmpty():
        rows.sparkSession.createDataFrame([("[]",)], "value string").write.mode("errorifexists").text(path)
        return
    # the first range holds the least key, so its first row opens the array
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).select(text.alias("value"), F.monotonically_increasing_id().alias("_at"))
    ranged.select(F.concat(F.when(F.col("_at") == 0, "[").otherwise(","), "value").alias("value")).union(rows.sparkSession.createDataFrame([("]",)], "value string")).write.mode("errorifexists").text(path)
