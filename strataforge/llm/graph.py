"""Connected components over written tables: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.store import materialize


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b), component being its smallest node.

    ``labels``, from a call over fewer links, is where to start. Each step takes the smallest label
    of the neighbours (aggregated before the shuffle) and then the label's own label; every step is
    a written table, and the joins are of plain tables, so that Spark can split a hub's rows.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    if labels is not None:
        nodes = nodes.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
    now, before = materialize(nodes, "labels"), None
    while True:
        near = edges.join(now.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        best = materialize(near.union(now).groupBy("node").agg(F.min("component").alias("component")), "labels")
        jump = best.select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = materialize(best.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        state = now.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
