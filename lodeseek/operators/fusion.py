"""Reciprocal rank fusion of any number of ranked lists: ranks count, scores don't.

Every list is read once: its scores travel with the ranks where they are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bm25 import top_k

RRF_K = 60


def _ranked(lists: list[DataFrame], scores: list[str] | None) -> DataFrame:
    """query_id, id, rank and a column for each of the names in scores: the list's score, null in the other lists."""
    rows = []
    for i, found in enumerate(lists):
        own = [(F.col("score") if i == j else F.lit(None)).cast("double").alias(name) for j, name in enumerate(scores or [])]
        rows.append(found.select("query_id", "id", "rank", *own))
    return reduce(DataFrame.unionByName, rows)


def fuse(lists: list[DataFrame], k: int | None = None, constant: int = RRF_K, scores: list[str] | None = None, counts: list[str] | None = None) -> DataFrame:
    """query_id, id, score, rank. lists: query_id, id, rank each; score is the sum of 1 / (constant + rank).

    scores: a name for each list, under which its own scores are returned (null where the
    id isn't in that list). counts: a name for each list, under which the number of the
    query's candidates in that list is returned; needs scores.
    """
    summed = _ranked(lists, scores).groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 10).alias("score"), *[F.max(name).alias(name) for name in scores or []]
    )
    for name, own in zip(counts or [], scores or []):
        summed = summed.withColumn(name, F.count(own).over(W.partitionBy("query_id")))
    return top_k(summed, k if k is not None else 2**31 - 1)


def ablation(lists: list[DataFrame], k: int, constants: list[int]) -> DataFrame:
    """constant, query_id, id, score, rank: fuse() with each of the constants; the lists are read once."""
    each = _ranked(lists, None).withColumn("constant", F.explode(F.array(*map(F.lit, constants))))
    summed = each.groupBy("constant", "query_id", "id").agg(F.round(F.sum(1.0 / (F.col("constant") + F.col("rank"))), 10).alias("score"))
    best = W.partitionBy("constant", "query_id").orderBy(F.desc("score"), "id")
    return summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def candidates(lists: list[DataFrame]) -> DataFrame:
    """query_id, id: what any of the lists holds, once."""
    return reduce(DataFrame.unionByName, [x.select("query_id", "id") for x in lists]).distinct()
