"""Connected components of a link table, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Each round takes the smallest root among neighbours and then jumps to the root's root, so that the number of rounds
    grows with the logarithm of a component's diameter; each round ends in a written table. A hub has one row in ``labels`` and
    many in ``both``: tables are written before they meet, so that Spark knows their sizes and splits the many rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = step.join(up, step.root == up.up, "left").select("node", F.least("root", "top").alias("root"), (F.least("root", "top") < F.col("old")).alias("moved"))
        new = written(new, "labels")
        drop_written(labels)
        labels = new.select("node", "root")
        if not new.where("moved").take(1):
            drop_written(both)
            return labels
