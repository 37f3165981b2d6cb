"""Connected components of a link table, by hash-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Each round every node takes the smallest label of its neighbours, then the label of that label, so that long chains
    close in a logarithmic number of rounds. An empty link table gives an empty result.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("up"))
        after = saved(step.join(up, "via").select("node", "old", F.least("via", "up").alias("component")))
        moved = after.filter("old <> component").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
