"""Mixing sources to target weights: rates per source, then whole copies and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, text_of, unused

#: A table of at most so many sources is broadcast; beyond, a shuffle join that adaptive execution splits.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """source, source_size, target, rate. sizes: source, size (long).

    Sources stand by code point, null last, and take the weights in turn. Targets share
    the total by weight and stop at max_repeat times the source's size; what is over is
    shared again among the others by weight. That is target = min(cap, level * weight),
    with a level found by a few aggregates over the sources.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # each partition has a range of the sources; written, so that the numbers below stay as they are
    sources = stage(summed.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before, n = {}, 0
    for part, rows in sorted(map(tuple, sources.groupBy("part").count().collect())):  # a row for each partition
        before[part], n = n, n + rows
    starts = spark.createDataFrame(sorted(before.items()), "part int, before long")
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    ranked = stage(
        sources.join(F.broadcast(starts), "part").select(
            "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeat).alias("cap")
        ),
        "ranked-sources",
    )
    total, left, shared = ranked.agg(F.sum("source_size"), F.sum("source_size"), F.sum("weight")).first()
    level, capped = (left / shared if shared else 0.0), -1
    while total and shared:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        caps, shared_now, n_capped = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n_capped == capped or not shared_now:
            break
        level, capped = (total - caps) / shared_now, n_capped
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), target / F.col("source_size"))).otherwise(0.0)
    out = ranked.select("source", "source_size", target.alias("target"), rate.alias("rate"))
    return F.broadcast(out) if n <= BROADCAST_SOURCES else out


def copies(seed: str = "mix") -> Column:
    """floor(rate), and one more with the probability that is left, drawn by a hash of doc_id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)
    whole = F.floor("rate")
    return (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """docs with columns size, source_size, target, rate, copies; `repeat_rows` makes the copies.

    docs: doc_id, source, text; all its columns are kept, but for those five names. The
    size is the text's count of words (null: 0). Sources whose texts are all empty take
    nothing. Rows that repeat a doc_id draw alike. An empty table gives an empty one.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*added)
    sizes = stage(docs.select("source", word_count(text_of()).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "source-sizes")
    of_source = unused("rates_source", docs.columns)
    rates = source_rates(sizes, weights, max_repeat).select(F.col("source").alias(of_source), "source_size", "target", "rate")
    joined = docs.withColumn("size", word_count(text_of())).join(rates, F.col("source").eqNullSafe(F.col(of_source)))
    return joined.withColumn("copies", copies(seed)).select(*docs.columns, *added)


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as many times as `copies` says; none for 0."""
    number = unused("copy_no", mixed.columns)
    return mixed.filter("copies > 0").withColumn(number, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", taken)


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sources
), steps AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         coalesce(sum(cap) OVER before, 0)::BIGINT AS caps_before, (sum(weight) OVER from_here)::BIGINT AS weight_left
  FROM ranked
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         from_here AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT min_by((total - caps_before) / weight_left, cap / weight) AS level
  FROM steps WHERE (total - caps_before) / weight_left <= cap / weight
), rated AS (
  SELECT r.source, r.source_size, least(r.cap::DOUBLE, l.level * r.weight) AS target FROM ranked r, level l
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM rated
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       ((floor(r.rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                               < r.rate - floor(r.rate) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""
