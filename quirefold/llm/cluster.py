"""Connected components, with checkpoints in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of edges (a, b): the least node that can be reached.

    Labels spread to neighbours and are then shortened by one pointer jump, until none
    changes; about log2 of the longest path rounds. Every step is a join or a minimum
    with map-side combination, so the degree of a node is no limit.
    """
    both = checkpoint(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("over"))
        now = checkpoint(step.join(jump, "mid").select("node", "old", F.least("mid", "over").alias("component")))
        labels = now.select("node", "component")
        if now.where("component <> old").isEmpty():
            return labels
