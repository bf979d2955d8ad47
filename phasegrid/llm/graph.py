"""Connected components by the smallest label, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge: component is the smallest node that edges reach.

    Each round a node takes the least label of itself, its neighbours and its label's node, so that labels travel twice
    as far in each round. Rows with a null end count for nothing. Rounds are stored; only their number of changes
    reaches the driver. No edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        pairs.select(F.col(b).alias("node"), F.col(a).alias("other"))
    )
    both = stored(both.distinct(), "edges")
    labels = last = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "component")
        jump = labels.select("node", F.col("component").alias("via")).join(
            labels.select(F.col("node").alias("via"), "component"), "via"
        ).select("node", "component")
        best = near.unionByName(jump).unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        moved = stored(best.join(labels.withColumnRenamed("component", "was"), "node"), "labels")
        labels = moved.select("node", "component")
        done = moved.where("component <> was").isEmpty()
        discard(last, shuffles=False)
        last = moved
        if done:
            discard(both)
            return labels
