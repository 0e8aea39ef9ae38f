"""Shared-folder tables, stable row identity and distributed row positions.

Every table that an operator writes between two steps goes below the folder that the cluster
names in ``spark.checkpoint.dir``; executors may be lost at any time without losing it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import tempfile
import threading
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of the internal columns, so that a table's own columns never clash with them.
P = "_sf_"
RID = [f"{P}file", f"{P}row"]
#: Prefix of the bucketed tables in the warehouse.
TABLES = "strataforge_blocks_"
#: Bytes that a shuffled part aims at where a table's size decides the number of parts.
PART_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of this machine; another one an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/strataforge/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what the operators wrote in this session; results not yet written elsewhere go with it."""
    for table in spark.catalog.listTables(pattern=f"{TABLES}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    _delete(spark, f"{shared_dir(spark)}/strataforge/{spark.sparkContext.applicationId}")
    _written.names.clear()


class _Written(threading.local):
    """Folders and tables that operators wrote in this thread of the driver, in order."""

    def __init__(self) -> None:
        self.names: list[str] = []


_written = _Written()


def written(name: str) -> str:
    """Note a folder or table of an operator, so that ``drop_since`` finds it."""
    _written.names.append(name)
    return name


def mark() -> int:
    return len(_written.names)


def drop_since(spark: SparkSession, start: int, keep: int = 0) -> None:
    """Delete what this thread wrote since ``mark`` gave ``start``, but for the last ``keep`` of it."""
    end = len(_written.names) - keep
    gone = _written.names[start:end]
    del _written.names[start:end]
    for name in gone:
        if name.startswith(TABLES):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            _delete(spark, name)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(written(path))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def quoted(name: str) -> str:
    """A column's name as an identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def total_bytes(rows: DataFrame, column: str) -> int:
    """Bytes of a string or binary column of all rows."""
    return int(rows.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into parts of about ``PART_BYTES`` where ``size`` bytes ask for more parts than the session has."""
    parts = size // PART_BYTES + 1
    return df.repartition(parts, *keys) if parts > partitions(df.sparkSession) else df


#: A group is hot that holds more than one in so many of all rows; there are fewer such groups than this.
HOT = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` (a written table) joined with ``groups``, one row per ``key`` with its number of rows in ``size``.

    The rows of hot groups meet them where they are, by a broadcast of fewer than ``HOT`` rows (their
    sizes add up to no more than the table's), so no key's rows gather in one task.
    """
    hot = materialize(groups.where(F.col(size) * HOT > rows.count()), "hot")
    met = rows.join(F.broadcast(hot), key)
    return met.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key, how))


def is_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that file and row number identify them."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def identified(docs: DataFrame, *columns: str, scan: bool = False) -> DataFrame:
    """``columns`` of ``docs`` plus a row identity that any re-evaluation repeats.

    A plain file scan (``scan=True``) is identified by file and row number, which cost nothing
    and tell repeated rows apart. Anything else is written to the shared folder first.
    """
    if not scan:
        docs = materialize(docs.select(*columns), "rows")
    return docs.select(
        *columns,
        F.xxhash64(F.col("_metadata.file_path")).alias(RID[0]),
        F.col("_metadata.row_index").alias(RID[1]),
    )


#: Bytes of bitmaps that are broadcast at most; beyond, rows of a file that one written bitmap covers.
BITMAP_BYTES, BITMAP_ROWS = 64 << 20, 1 << 22


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of the file scan ``docs`` whose identity is in ``kept``, without moving them: the decisions travel, a bit per row.

    Bitmaps of up to ``BITMAP_BYTES`` (half a billion rows) are broadcast to the scan, which never leaves the JVM; more of them
    are written to the shared folder and read by the tasks that scan their rows.
    """
    number = F.col(RID[1]) + 1
    bits = kept.select(RID[0], F.bitmap_bucket_number(number).alias(f"{P}chunk"), F.bitmap_bit_position(number).alias("p")).groupBy(RID[0], f"{P}chunk").agg(F.bitmap_construct_agg("p").alias(f"{P}bits"))
    bits = materialize(bits, "bits")
    if bits.count() * 4096 > BITMAP_BYTES:  # the size of one
        return _kept_by_files(docs, kept)
    known = docs.select(*(F.col(quoted(c)) for c in docs.columns), F.xxhash64(F.col("_metadata.file_path")).alias(RID[0]), F.col("_metadata.row_index").alias(RID[1]))
    at = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"{P}bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = F.broadcast(bits.withColumnRenamed(RID[0], f"{P}name"))
    is_set = F.call_function("getbit", byte, at % 8) == 1
    return known.join(here, (F.col(RID[0]) == F.col(f"{P}name")) & (F.bitmap_bucket_number(number) == F.col(f"{P}chunk")) & is_set, "left_semi").drop(*RID)


def _kept_by_files(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept_rows`` with a written bitmap for every ``BITMAP_ROWS`` rows of a file; what is broadcast is their names."""
    spark = docs.sparkSession
    folder, columns = fresh_dir(spark, "bitmaps"), docs.columns
    plain = [f"{P}c{k}" for k in range(len(columns))]  # under names that hold no dots
    chunk, place = F.expr(f"{RID[1]} div {BITMAP_ROWS}").alias(f"{P}chunk"), F.expr(f"cast({RID[1]} % {BITMAP_ROWS} as int)").alias(f"{P}at")

    def write(table: pa.Table) -> pa.Table:
        bits = np.zeros(BITMAP_ROWS, bool)
        bits[table[f"{P}at"].to_numpy()] = True
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.bits"  # a repeated attempt writes a file of its own
        with store.open_output_stream(f"{root}/{name}") as file:
            file.write(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        return table.select([RID[0], f"{P}chunk"]).slice(0, 1).append_column(f"{P}uri", pa.array([f"{folder}/{name}"]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=8)
        def bitmap(uri: str) -> np.ndarray:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                return np.unpackbits(np.frombuffer(zlib.decompress(file.read()), np.uint8), bitorder="little").view(bool)

        for batch in batches:
            names, at = batch.column(len(columns) + 1).dictionary_encode(), batch.column(len(columns)).to_numpy()
            which, stays = names.indices.to_numpy(), np.zeros(len(batch), bool)
            for k, uri in enumerate(names.dictionary.to_pylist()):
                here = np.flatnonzero(which == k)
                stays[here] = bitmap(uri)[at[here]]
            yield batch.select(plain).filter(pa.array(stays))

    made = kept.select(RID[0], chunk, place).groupBy(RID[0], f"{P}chunk").applyInArrow(write, f"{RID[0]} long, {P}chunk long, {P}uri string")
    uris = materialize(made, "bitmaps")
    written(folder)
    known = docs.select(*(F.col(quoted(c)) for c in columns), F.xxhash64(F.col("_metadata.file_path")).alias(RID[0]), F.col("_metadata.row_index").alias(RID[1]))
    met = known.select("*", chunk, place).join(F.broadcast(uris), [RID[0], f"{P}chunk"])  # a name for every BITMAP_ROWS rows
    rows = met.select(*(F.col(quoted(c)).alias(n) for c, n in zip(columns, plain, strict=True)), f"{P}at", f"{P}uri")
    return rows.mapInArrow(keep, rows.select(*plain).schema).toDF(*columns)


def range_positions(df: DataFrame, order: list[Column | str], kind: str) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions, with its global position ``_sf_pos``.

    The sort is distributed: a range partition numbers its own rows, and the sizes of the
    partitions (one row each) give every partition its base. The result is a written table.
    """
    n = partitions(df.sparkSession)
    local = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(f"{P}local", F.monotonically_increasing_id()),
        kind,
    )
    part = F.shiftright(f"{P}local", 33)
    sizes = local.groupBy(part.alias(f"{P}part")).agg(F.count("*").alias(f"{P}size"))
    before = Window.orderBy(f"{P}part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(f"{P}part", F.coalesce(F.sum(f"{P}size").over(before), F.lit(0)).alias(f"{P}base"))
    return (
        local.withColumn(f"{P}part", part)
        .join(F.broadcast(base), f"{P}part")  # as many rows as range partitions
        .withColumn(f"{P}pos", F.col(f"{P}base") + F.col(f"{P}local") - F.shiftleft(F.col(f"{P}part").cast("long"), 33))
        .drop(f"{P}local", f"{P}part", f"{P}base")
    )
