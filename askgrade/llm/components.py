"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrade.session import discard, materialise

MAX_BROADCAST_ROWS = 1 << 21


def small_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows, read from a table) marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """``node, <name>``: the smallest node reachable, for every node of ``edges`` (``a, b``).

    Every round each node takes the smallest label around it and then that label's label, so
    paths halve; each round's labels are written, so lineage stays short, and deleted when the next
    ones are there.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        around = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("label").alias("m"))
        )
        lower = materialise(
            labels.join(around, F.col("node") == F.col("a"))
            .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")),
            "labels",
        )
        discard(labels)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = materialise(
            lower.join(up, "label", "left")
            .select("node", "old", F.coalesce("upper", "label").alias("label")),
            "labels",
        )
        discard(lower)
        if labels.where("label <> old").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias(name))
        labels = labels.select("node", "label")
