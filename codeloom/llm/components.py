"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back, so that a node with very many
neighbours is never gathered in one place; every round is written to the shared
folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize


def _stars(near: DataFrame) -> DataFrame:
    """Link each (node, other) to the smallest of node and its others."""
    low = near.groupBy("node").agg(F.min("other").alias("_m")).select(F.col("node").alias("_n"), F.least("_m", "node").alias("low"))
    return near.join(low, near["node"] == low["_n"]).select("node", "other", "low")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; component is its smallest node.

    ``edges`` has columns a and b of one orderable type. Loops and repeated edges are
    harmless; edges with a null end are ignored; no edges give no rows.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, mark = materialize(both, "links"), None
    for _ in range(most_rounds):
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        large = _stars(near).filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        s = _stars(large.select(F.col("a").alias("node"), F.col("b").alias("other")))
        small = s.select(F.explode(F.array("node", "other")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        links = materialize(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        mark = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
