"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum followed by an equi-join on the same key, so no neighbour list
is ever gathered. Labels are the smallest node of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.storage import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    out = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; ``a`` is above ``b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("sum(xxhash64(a, b) % 1000000007)").alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge other than a loop; ``edges`` has long a, b.

    Nulls and loops are ignored, repeated edges count once, and no edges give no rows.
    A repeat of both steps that changes nothing ends the loop; every round is checkpointed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    before = _digest(edges)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)))
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
