"""Connected components of an edge table by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .util import save


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component, for edges (a, b).

    Each round a node takes the least label around it (aggregated before the
    shuffle, so a hub is no hot group) and then its label's label, until
    nothing changes; labels are written to the shared folder every round."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        around = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        step = save(step)
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = save(step.join(jump, "low").select("node", F.least("low", "lower").alias("new"), "root"))
        changed = new.filter(F.col("new") != F.col("root")).limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
