"""Breadth-first crawl over a table of pages: frontier joined with the link table, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from .numbering import kept


def links(pages: DataFrame) -> DataFrame:
    """url, target, normalized both. pages: url, html."""
    parsed = pages.select("url", html.extract("html", "url").alias("x"))
    targets = parsed.select(T.normalize_url(F.col("url")).alias("url"), F.explode("x.links").alias("t"))
    return targets.select("url", T.normalize_url(F.regexp_replace("t", "#.*$", "")).alias("target")).distinct()


def crawl(edges: DataFrame, start: list[str], max_depth: int, max_pages: int | None = None, scope: str | None = None) -> DataFrame:
    """url, depth of what is reached from start within max_depth links; of a level that passes max_pages, the first urls.

    Each level is checkpointed, so that a plan doesn't grow with the depth.
    """
    spark = edges.sparkSession
    edges = edges.select("url", "target")
    if scope:
        edges = edges.filter(T.in_scope(F.col("target"), F.lit(scope)))
    found = spark.createDataFrame([(u,) for u in dict.fromkeys(start)], "url string").select(T.normalize_url(F.col("url")).alias("url"), F.lit(0).alias("depth"))
    frontier, total = found, found.count()
    for depth in range(1, max_depth + 1):
        if max_pages is not None and total >= max_pages:
            break
        new = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(found, "url", "left_anti").withColumn("depth", F.lit(depth))
        if max_pages is not None:
            new = new.orderBy("url").limit(max_pages - total)
        new = kept(new)
        n = new.count()
        if not n:
            break
        total += n
        found, frontier = found.unionByName(new), new
    return found

