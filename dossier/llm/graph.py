"""Connected components of an edge table, by joins on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges(a, b)``; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then follows that label
    to its own label, so labels travel exponentially far. Every round is written to the shared
    folder. Neighbour minima combine before the shuffle; joins on a node of many edges are plain
    sort-merge joins, which adaptive execution splits. Null ends and loops are ignored.
    """
    ends = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = settle(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")),
        "labels",
    )
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("component").alias("near"))
        hop = settle(labels.join(near, F.col("node") == F.col("to")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before"),
        ), "labels")
        ahead = hop.select(F.col("node").alias("step"), F.col("component").alias("ahead"))
        jump = settle(hop.join(ahead, F.col("component") == F.col("step")).select(
            "node", F.least("component", "ahead").alias("component"), "before",
        ), "labels")
        if jump.where("component <> before").isEmpty():
            return jump.select("node", "component")
        labels = jump.select("node", "component")
