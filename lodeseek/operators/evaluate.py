"""Quality of ranked results, and tests of significance between systems."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import numbering

CUTOFFS = (1, 3, 5, 10, 20, 100)


def metrics_at_k(results: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """query_id, k, ndcg, precision, recall, f1 for each query of results (by: for each of these columns, query_id among them).

    results: the columns of by, id, rank; qrels: query_id, id, relevance (unjudged: 0). Gain is
    2^relevance - 1; NDCG and recall are 1 where nothing is relevant; precision is of k.
    """
    judged = results.join(qrels, ["query_id", "id"], "left").select(*by, "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)
    # the best order needs the number of each relevance alone, so that no judgment is sorted
    levels = qrels.filter("relevance > 0").groupBy("query_id", "relevance").agg(F.count("*").alias("n"))
    levels = levels.withColumn("end", F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("relevance"))))
    weights = [0.0, *accumulate(1 / math.log2(r + 1) for r in range(1, max(cutoffs) + 1))]
    upto = lambda place, k: F.get(F.array(*map(F.lit, weights[: k + 1])), F.least(place, F.lit(k)).cast("int"))
    worth = lambda k: (F.pow(F.lit(2.0), F.col("relevance")) - 1) * (upto(F.col("end"), k) - upto(F.col("end") - F.col("n"), k))
    dcg = judged.groupBy(*by).agg(
        *[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in cutoffs],
        *[F.count_if((F.col("rank") <= k) & (F.col("relevance") > 0)).alias(f"hit_{k}") for k in cutoffs],
    )
    best = levels.groupBy("query_id").agg(F.sum("n").alias("n_relevant"), *[F.sum(worth(k)).alias(f"ideal_{k}") for k in cutoffs])
    joined = dcg.join(best, "query_id", "left")
    at = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"dcg_{k}").alias("dcg"), F.col(f"hit_{k}").alias("hit"), F.col(f"ideal_{k}").alias("ideal")) for k in cutoffs])
    )
    rows = joined.select(*by, "n_relevant", at.alias("x")).select(*by, "n_relevant", "x.*")
    precision = F.col("hit") / F.col("k")
    recall = F.when(F.coalesce("n_relevant", F.lit(0)) == 0, 1.0).otherwise(F.col("hit") / F.col("n_relevant"))
    return rows.select(
        *by,
        "k",
        F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 1.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )


def ranking_metrics(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, ap (of all relevant ones; 0 for none), rr (0 without a relevant result)."""
    relevant = qrels.filter("relevance > 0")
    found = results.join(relevant.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    seen = F.count("hit").over(W.partitionBy("query_id").orderBy("rank"))
    summed = found.withColumn("at", F.when(F.col("hit") == 1, seen / F.col("rank"))).groupBy("query_id").agg(
        F.coalesce(F.sum("at"), F.lit(0.0)).alias("precisions"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return summed.join(total, "query_id", "left").select(
        "query_id", F.coalesce(F.col("precisions") / F.col("n_relevant"), F.lit(0.0)).alias("ap"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr")
    )


def median_scores(results: DataFrame) -> DataFrame:
    """query_id, n, median_score: the score at place n div 2 (from 0), not a mean of two; results: query_id, rank (from 1, no gaps), score."""
    sizes = results.groupBy("query_id").agg(F.max("rank").cast("long").alias("n"))
    return results.join(sizes, "query_id").filter("rank = n div 2 + 1").select("query_id", "n", F.col("score").alias("median_score"))


def means(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n_queries"))


def paired(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For pairs (a, b): n, mean_difference, t (0 without spread), cohens_d (pooled), wins and losses of a."""
    d = F.col("a") - F.col("b")
    rows = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"),
    )
    t = F.when(F.col("n") < 2, None).when(F.col("sd") < 1e-15, 0.0).otherwise(F.col("mean_difference") / (F.col("sd") / F.sqrt("n")))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    effect = F.when(F.coalesce(pooled, F.lit(0.0)) < 1e-15, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)
    return rows.select(*by, "n", "mean_difference", t.alias("t"), effect.alias("cohens_d"), "wins", "losses")


def significant(p: float | None, alpha: float = 0.05) -> bool:
    """p strictly below alpha; false without a p."""
    return p is not None and p < alpha


def three_way(metrics: DataFrame, metric: str, system: str, others: list[str]) -> DataFrame:
    """One row: n_queries, wins (the system strictly above all others), losses (strictly below all); a missing score is 0."""
    scores = metrics.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("system") == s, F.col(metric))), F.lit(0.0)).alias(s) for s in (system, *others)])
    above = reduce(lambda a, b: a & b, [F.col(system) > F.col(o) for o in others])
    below = reduce(lambda a, b: a & b, [F.col(system) < F.col(o) for o in others])
    return scores.agg(F.count("*").alias("n_queries"), F.count_if(above).alias("wins"), F.count_if(below).alias("losses"))


def effect_label(d: float) -> str:
    """Cut points 0.2, 0.5, 0.8."""
    return next((name for most, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium")) if abs(d) < most), "large")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_test_p(t: float | None, n: int) -> float | None:
    """Two-sided p of a paired t statistic; null for n < 2; the normal distribution above 100 degrees of freedom."""
    if t is None or n < 2:
        return None
    df = n - 1
    if df > 100:
        return math.erfc(abs(t) / math.sqrt(2))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


#: Multiplier and increment of the generator, modulo 2^64.
MULTIPLIER, INCREMENT = 6364136223846793005, 1
#: Draws made together.
DRAWS = 1 << 16
#: Values that travel to the tasks that drew them; more are met in a shuffle.
MAX_VALUES = 100_000


def draws(seed: int, n: int) -> np.ndarray:
    """The first n states of the linear congruential generator behind the seed, by doubling."""
    times, plus = np.array([MULTIPLIER], np.uint64), np.array([INCREMENT], np.uint64)
    while len(times) < n:  # state i + m is times[i] * (times[m - 1] * s + plus[m - 1]) + plus[i]
        times, plus = np.concatenate([times, times * times[-1]]), np.concatenate([plus, times * plus[-1] + plus])
    return times[:n] * np.uint64(seed % 2**64) + plus[:n]


def bootstrap_interval(values: list[float], samples: int = 1000, seed: int = 42, level: float = 0.95) -> tuple[float, float, float]:
    """Mean and bounds of the mean over resamples drawn by a 64-bit linear congruential generator; NaN for no values."""
    n = len(values)
    if not n:
        return (math.nan,) * 3
    data = np.array(values)
    drawn = (draws(seed, samples * n) % np.uint64(n)).astype(np.int64).reshape(samples, n)
    resampled = np.sort(data[drawn].mean(axis=1))
    tail = (1 - level) / 2
    return float(data.mean()), float(resampled[int(tail * samples)]), float(resampled[min(int((1 - tail) * samples), samples - 1)])


def state_after(seed: int, steps: int) -> int:
    """The generator's state so many steps behind the seed, by doubling."""
    times, plus, state, mask = MULTIPLIER, INCREMENT, seed, 2**64 - 1
    while steps:
        if steps & 1:
            state = (times * state + plus) & mask
        times, plus, steps = times * times & mask, (times * plus + plus) & mask, steps >> 1
    return state


def _draw(seed: int):
    """From group, n, resample, block: how often each of n values is drawn in a block of a resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, (n, resample, block) = batch.column(0).slice(i, 1), (batch.column(c)[i].as_py() for c in (1, 2, 3))
                first = block * DRAWS
                states = draws(state_after(seed, resample * n + first), min(DRAWS, n - first))
                place, times = np.unique(states % np.uint64(n), return_counts=True)
                size = len(place)
                yield pa.RecordBatch.from_arrays(
                    [group.take(pa.array(np.zeros(size, np.int64))), pa.array(np.full(size, resample)), pa.array(place.astype(np.int64)), pa.array(times.astype(np.int64))],
                    names=["group", "resample", "place", "times"],
                )

    return run


def bootstrap(values: DataFrame, by: str, value: str, order: str, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """by, mean, low, high: bootstrap_interval of each group's values, in the order of the column `order`, as a job.

    Tasks jump ahead in the generator to the resamples that they draw, in blocks of DRAWS,
    and send on how often they drew each value; values meet them by their number. Up to
    MAX_VALUES values go to every task, more are joined in a shuffle, so no task needs all
    of them. What was drawn is never broadcast: it is `samples` times the values. Null values are left out; a group without any has no row.
    """
    known = values.filter(F.col(value).isNotNull()).select(F.col(by).alias("group"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    numbered = numbering.kept(numbering.number(known, ["group", "order"], "i"))
    groups = numbered.groupBy("group").agg(F.min("i").alias("start"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    groups = numbering.kept(groups)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DRAWS))
    asked = groups.select("group", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("resample"), blocks.alias("blocks"))
    asked = asked.select("group", "n", "resample", F.explode("blocks").alias("block")).repartition("group", "resample", "block")
    kind = values.schema[by].dataType.simpleString()
    drawn = asked.mapInArrow(_draw(seed), f"group {kind}, resample long, place long, times long")
    starts = groups.select(F.col("group").alias("of"), "start")
    placed = numbered.join(starts, F.col("group").eqNullSafe(F.col("of"))).select("of", (F.col("i") - F.col("start")).alias("at"), "value")
    few = numbered.count() <= MAX_VALUES
    met = (drawn if few else drawn.hint("merge")).join(F.broadcast(placed) if few else placed, F.col("group").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    means = met.groupBy("group", "resample").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("m"))
    sorted_means = means.groupBy("group").agg(F.array_sort(F.collect_list("m")).alias("m"))  # `samples` of them
    tail = (1 - level) / 2
    low, high = (F.get("m", F.lit(min(int(t * samples), samples - 1))) for t in (tail, 1 - tail))
    named = sorted_means.select(F.col("group").alias("of"), low.alias("low"), high.alias("high"))
    return groups.join(named, F.col("group").eqNullSafe(F.col("of"))).select(F.col("group").alias(by), "mean", "low", "high")


def compare(metrics: DataFrame, metric: str, baseline: str, others: list[str]) -> DataFrame:
    """paired() of each other system against the baseline; metrics: system, query_id and the metric."""
    base = metrics.filter(F.col("system") == baseline).select("query_id", F.col(metric).alias("a"))
    pairs = [metrics.filter(F.col("system") == o).select("query_id", F.col(metric).alias("b"), F.lit(o).alias("other")).join(base, "query_id") for o in others]
    return paired(reduce(DataFrame.unionByName, pairs), ["other"])
