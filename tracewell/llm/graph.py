"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node of an edge. edges: (a, b), in either order.

    Each round gives every node the smallest label among its own and its neighbours', then the label of that label;
    tables are written each round, and only a count of changes reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        named = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        least = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        closer = labels.join(least, "node").select("node", "component", F.least("component", "near").alias("to"))
        heads = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        jumped = closer.join(heads, "to", "left")
        new = materialize(jumped.select("node", F.least("to", F.coalesce("jump", "to")).alias("component"), (F.least("to", F.coalesce("jump", "to")) != F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if not new.where("moved").limit(1).count():
            return labels
