"""Rolling performance figures over timed samples, as batch aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import numbering

NEWEST, PIPELINE_WINDOW_S, SEARCH_WINDOW_S = 1000, 60, 300
#: Size of the quantile sketches: errors of rank of about 0.4 % (1.3 % at Spark's default, 200).
SKETCH_K = 800


def newest(samples: DataFrame, by: str, keep: int = NEWEST) -> DataFrame:
    """The newest `keep` samples of each kind; ties by id. samples: by, id, ts, duration_ms."""
    order = W.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    return samples.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def snapshot(samples: DataFrame, by: str, window_s: int, keep: int = NEWEST) -> DataFrame:
    """by, n, average (null for none), throughput (of the whole window) at the time of the newest sample of all.

    Samples exactly window_s old still count.
    """
    now = samples.agg(F.max("ts").alias("now"))
    recent = newest(samples, by, keep).crossJoin(F.broadcast(now))  # now is one row
    inside = F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_s))
    return recent.groupBy(by).agg(F.count_if(inside).alias("n"), F.avg(F.when(inside, F.col("duration_ms"))).alias("average")).withColumn(
        "throughput", F.col("n") / float(window_s)
    )


def trailing(samples: DataFrame, by: str, window_s: int) -> DataFrame:
    """Each sample with the count and average over the window_s seconds up to it.

    Samples are summed up by second first, so that a frame holds at most window_s + 1 rows
    however dense they are. A kind's history is cut into stretches of window_s seconds;
    each also gets the seconds of the one before as context, so that a task holds two
    stretches, not a whole kind.
    """
    second = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long")
    timed = samples.withColumn("_s", second)
    summed = timed.groupBy(F.col(by).alias("_kind"), F.col("_s").alias("_second")).agg(F.count("*").alias("_n"), F.count("duration_ms").alias("_sized"), F.sum("duration_ms").alias("_total"))
    summed = summed.withColumn("_own", F.floor(F.col("_second") / window_s).cast("long"))
    placed = summed.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = W.partitionBy("_kind", "_stretch").orderBy("_second").rangeBetween(-window_s, 0)
    rolled = placed.select("_kind", "_second", "_own", "_stretch", F.sum("_n").over(w).alias("n"), F.try_divide(F.sum("_total").over(w), F.sum("_sized").over(w)).alias("average"))
    rolled = rolled.filter("_stretch = _own").select("_kind", "_second", "n", "average")
    return timed.join(rolled, F.col(by).eqNullSafe(F.col("_kind")) & (F.col("_s") == F.col("_second"))).drop("_s", "_kind", "_second")


def percentiles(samples: DataFrame, by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact order statistics: the sample at index floor(share * n) in ascending order.

    All samples are numbered in order of kind and duration over ranges, so that a large
    kind spreads over tasks; the wanted ones are then joined by number.
    """
    placed = numbering.number(samples.select(by, "duration_ms", "id"), [by, "duration_ms", "id"], "_i")
    groups = placed.groupBy(by).agg(F.min("_i").alias("_start"), F.count("*").alias("_n"))
    wanted = groups.select(
        F.col(by).alias("_kind"), F.explode(F.array(*[F.struct((F.col("_start") + F.floor(F.col("_n") * s)).alias("_i"), F.lit(s).alias("share")) for s in shares])).alias("x")
    ).select("_kind", "x.*")
    return placed.join(wanted, "_i").groupBy(F.col("_kind").alias(by)).agg(*[F.max(F.when(F.col("share") == s, F.col("duration_ms"))).alias(f"p{round(s * 100)}") for s in shares])


def quantile_sketches(samples: DataFrame, by: str, window: str, k: int = SKETCH_K) -> DataFrame:
    """by, window_start, n, sketch: one mergeable quantile sketch (KLL) for each kind and window, summed up before the shuffle.

    A batch or a stream; null durations are left out. k sets a sketch's size and error.
    """
    timed = samples.filter("duration_ms IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.groupBy(F.col(by), F.window("ts", window))
    sketched = grouped.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), k).alias("sketch"))
    return sketched.select(by, F.col("window.start").alias("window_start"), "n", "sketch")


def merged_percentiles(sketches: DataFrame, by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """by, n, p50, ...: percentiles over any windows whose sketches (of quantile_sketches) are given, without their samples; off by a rank of 1 % at most."""
    merged = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_all"))
    return merged.select(by, "n", *[F.kll_sketch_get_quantile_double("_all", F.lit(float(s))).alias(f"p{round(s * 100)}") for s in shares])


def batch_totals(batches: DataFrame) -> DataFrame:
    """Sums over batches and the tokens a chunk as a whole number, 0 without chunks; batches: n_docs, n_chunks, n_tokens (long, null: no figures yet)."""
    summed = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_chunks", "n_tokens")])
    return summed.withColumn("tokens_per_chunk", F.when(F.col("n_chunks") > 0, F.expr("n_tokens div n_chunks")).otherwise(0))


def live_rates(batches: DataFrame) -> DataFrame:
    """tokens_per_s, chunks_per_s, ms_per_chunk, is_live of the first active batch that has chunks, else of the batch completed last; no row without either.

    batches: batch_id (a number), active (boolean), completed_at, n_chunks, n_tokens,
    total_ms (null: no figures yet). Rates are 0 where no time has passed.
    """
    is_live = F.col("active") & (F.coalesce("n_chunks", F.lit(0)) > 0)
    able = batches.withColumn("is_live", is_live).filter("is_live OR (NOT active AND n_chunks IS NOT NULL)")
    latest = F.struct("is_live", F.when(~F.col("is_live"), F.col("completed_at")), F.when(F.col("is_live"), -F.col("batch_id")).otherwise(F.col("batch_id")))
    b = able.agg(F.max_by(F.struct("n_chunks", "n_tokens", "total_ms", "is_live"), latest).alias("b")).filter("b IS NOT NULL").select("b.*")

    def rate(n: str, of: Column) -> Column:
        return F.when(of > 0, F.col(n) / of).otherwise(0.0)

    seconds = F.col("total_ms") / 1000.0
    return b.select(
        rate("n_tokens", seconds).alias("tokens_per_s"), rate("n_chunks", seconds).alias("chunks_per_s"),
        rate("total_ms", F.col("n_chunks")).alias("ms_per_chunk"), "is_live",
    )


def search_records(records: DataFrame) -> DataFrame:
    """total_ms: the sum of a search's four parts; records: vector_ms, keyword_ms, fusion_ms, hydrate_ms."""
    return records.withColumn("total_ms", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("vector_ms", "keyword_ms", "fusion_ms", "hydrate_ms")), F.lit(0.0)))
