"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.session import write_through


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``): the smallest node it reaches.

    Each round takes the least label among the neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path. Minima are
    combined before the shuffle, so a node with very many edges is no hot spot, and each
    round is written to the shared folder.
    """
    both = write_through(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = write_through(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = write_through(lower, "labels-near")
        above = lower.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = write_through(lower.join(above, "component").select("node", "was", F.least("component", "above").alias("component")), "labels")
        if labels.filter("was <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
