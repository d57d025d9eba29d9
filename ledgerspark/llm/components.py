"""Connected components of a table of links, by alternating large and small stars.

Each round is two groupings and two joins over what links remain; rounds grow with the logarithm of a component's
width. Nothing but two numbers a round comes to the driver. A hub's links are joined by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node in a link (a, b); links to itself and repeats don't matter."""
    edges = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every larger neighbour of a node points at the node's least neighbour
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every smaller neighbour, and the node itself, point at the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = common.stored(small.where("a <> b").distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x or 0
