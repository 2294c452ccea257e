"""Result sinks: ranked listings, JSON, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def as_json(results: DataFrame) -> DataFrame:
    """A JSON string for each row, nulls left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def as_listing(results: DataFrame, snippet: int = 200) -> DataFrame:
    """rank. [score] title, and a snippet below; results: rank, score, title, text."""
    line = F.format_string("%d. [%.4f] %s\n   %s", F.col("rank"), F.col("score"), F.coalesce("title", F.lit("untitled")), T.snippet(F.col("text"), snippet))
    return results.select("rank", line.alias("line")).orderBy("rank")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
