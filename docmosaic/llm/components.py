"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, free_shuffles


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges (a, b long).

    Each round takes the smallest label among a node and its neighbours and then that label's own label, so paths shrink by
    more than half. Labels only fall; the loop ends when their sum stands still. Every round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("parent"), F.col("label").alias("up"))
        new = cut(least.join(up, F.col("label") == F.col("parent"), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")))
        now = new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        drop_cut(labels)
        free_shuffles(edges.sparkSession)
        labels = new
        if now == total:
            break
        total = now
    drop_cut(both)
    return labels
