"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and all of its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges(a, b)`; the label is the smallest node of its component.

    Alternates two steps until nothing changes: neighbours larger than a node move to its smallest
    neighbour, then the smaller ones do. The number of rounds grows with the logarithm of the
    graph, and each round is an aggregate and a join, which split the neighbours of a hub.
    """
    forest = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = _smallest(large.where("u > v"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            hung.select("u", F.col("m").alias("v"))
        )
        forest = cut(small.where("u <> v").distinct())
        now = forest.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = forest.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
