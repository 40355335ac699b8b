"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours in edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(x, y) with another component than itself: the least node it reaches.

    Each round halves the distance to the least node at least; links only ever shrink to
    stars, so the tables stay as large as the links.  Null ends and loops are ignored.
    """
    edges = scratch.table(links.filter("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        own = _least(large)
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        new = scratch.table(small.filter("u <> v").distinct(), "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
