"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b"), F.col("a"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node's smaller neighbours, and the node, at the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is its least node.

    Each round halves the depth of the trees at least, writes its edges to the shared folder
    and brings only their count and hash sum to the driver. Nodes with many edges are split by
    AQE, since the joins keep the edges on one side and one row per node on the other. Loops,
    repeated edges and NULL ends are ignored; without edges the result is empty.
    """
    clean = edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = stored(clean.distinct(), "edges")
    seen = None
    while True:
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select("b", "b").distinct()
            )
        seen = state
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
