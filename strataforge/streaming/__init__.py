"""Streams into create-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strataforge.operators.lifecycle import append_create_only


def create_only_stream(stream: DataFrame, key: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to the Parquet table at ``path``, each key once.

    A batch that is run again finds its own rows and adds nothing; other content under a known key
    stops the stream.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        rows, spark = batch.select(key, value), batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        held = spark.read.schema(rows.schema).parquet(path) if there else rows.limit(0)
        append_create_only(held, rows, key, value, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
