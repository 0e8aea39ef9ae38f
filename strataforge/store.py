"""Tables between two steps, in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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
    return f"{shared_dir(spark)}/steps/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read back: its lineage ends here."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, and the path, as the session's Java objects."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def release(spark: SparkSession) -> None:
    """Delete what this session has written; results that depend on it must have been written elsewhere."""
    system, folder = filesystem(spark, f"{shared_dir(spark)}/steps/{spark.sparkContext.applicationId}")
    system.delete(folder, True)
