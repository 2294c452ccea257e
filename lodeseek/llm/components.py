"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each v, and u, hung on the smallest of u and its v."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    # both sides are tables, so that a node with very many neighbours can be split among tasks
    hung = pairs.join(least, "u")
    hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = stage(hung.filter("a > b").distinct(), "star-edges")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges (a, b), a <> b, neither null.

    Each step is written to the shared folder. The tables never grow beyond two rows an
    edge, and the number of rounds grows with the logarithm of a component's width.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        up, down = edges.select(F.col("b").alias("u"), F.col("a").alias("v")), edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = stage(up.union(down), "both-ways")
        # large star: only larger neighbours move
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = stage(
            both.filter("v > u").join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star"
        )
        discard(least)
        discard(both)
        old, edges = edges, _star(large)  # small star: neighbours are all smaller here
        discard(large)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
