"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star steps: every round is two aggregations and
joins over the edges, no task holds a component, and the number of rounds grows
with the logarithm of the component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and it, are tied to the smallest of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, to a root: then a root is the smallest of its component, as edges have a > b."""
    roles = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return roles.groupBy("a").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its smallest node.

    Null ends, loops and repeated edges do not count; a node that has only such
    edges does not occur; an empty table gives none.
    """
    tidy = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at = scratch.table(tidy, "cc")
    while not _is_stars(at):
        new = scratch.table(_small_star(_large_star(at)), "cc")
        scratch.drop(at)
        at = new
    roots = at.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
