"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing but counts comes to the driver. Every step is a partial aggregation and
a join, so a node with a third of all edges is handled piece by piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) for directed edges: m is the least node among u and its neighbours."""
    least = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node it reaches."""
    now = materialize(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to u's least neighbour.
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        # Small star: u and its lower neighbours go to the least of them.
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "cc")
        # Done when all edges lead to roots, one from each node.
        roots = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if roots.isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty():
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
