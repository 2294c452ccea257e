import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import rolling
from lodeseek.streaming import rolling as streams

SCHEMA = "id long, k string, ts timestamp, duration_ms double"
START = dt.datetime(2024, 1, 1)


def samples(spark, rows):
    """rows: id, kind, seconds, duration."""
    return spark.createDataFrame([(i, k, START + dt.timedelta(seconds=s), float(v)) for i, k, s, v in rows], SCHEMA)


def run(spark, tmp_path, rows, keep, window_s, late="10 minutes"):
    samples(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    streams.keep_snapshots(stream, "k", window_s, str(tmp_path / "states"), str(tmp_path / "checkpoint"), keep, late).awaitTermination()
    return streams.Snapshots(spark, str(tmp_path / "states"))


def figures(df):
    return sorted((r.k, r.n, None if r.average is None else round(r.average, 9), r.throughput) for r in df.collect())


def test_state_equals_snapshot_after_restarts(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b"]), int(i * 0.5 + rng.integers(0, 40)), rng.integers(0, 100)) for i in range(900)]
    rows += [(2000 + i, "tied", 100, i) for i in range(30)]
    seen = []
    for part in (rows[:300], rows[300:320], rows[320:]):  # each time the query starts anew from its checkpoint
        table = run(spark, tmp_path, part, 20, 120)
        seen += part
        assert figures(table.read("k", 120, 20)) == figures(rolling.snapshot(samples(spark, seen), "k", 120, 20))
    assert len(list((tmp_path / "states").glob("batch=*"))) <= 3


def test_a_timer_empties_what_no_window_reaches(spark, tmp_path):
    run(spark, tmp_path, [(1, "old", 0, 5), (2, "new", 1, 7)], 10, 60, "1 second")
    table = run(spark, tmp_path, [(3, "new", 4000, 9)], 10, 60, "1 second")
    table = run(spark, tmp_path, [(4, "new", 4001, 11)], 10, 60, "1 second")
    states = table._states(max(table._versions())).filter("kind = 'old'").collect()
    assert len(states) == 1 and states[0].samples == []
    assert figures(table.read("k", 60, 10)) == [("new", 2, 10.0, 2 / 60), ("old", 0, None, 0.0)]


def test_a_repeated_batch_is_written_the_same(spark, tmp_path):
    table = run(spark, tmp_path, [(1, "a", 0, 5), (2, "b", 1, 7)], 10, 60)
    last = max(table._versions())
    before = figures(table.read("k", 60))
    table.write(table._states(last).filter("kind = 'a'"), last + 1)
    table.write(table._states(last).filter("kind = 'a'"), last + 1)
    assert figures(table.read("k", 60)) == before


@pytest.mark.parametrize("n", [1, 7, 30_000])
def test_merged_percentiles_are_near_the_exact_ones(spark, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise("other").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.exp(F.randn(3) * 2).alias("duration_ms"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows = rows.unionByName(rows.limit(1).withColumn("duration_ms", F.lit(None).cast("double")))
    sketches = rolling.quantile_sketches(rows, "k", "10 minutes")
    got = {r.k: r for r in rolling.merged_percentiles(sketches, "k").collect()}
    values = {}
    for r in rows.filter("duration_ms IS NOT NULL").collect():
        values.setdefault(r.k, []).append(r.duration_ms)
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in values.items()}
    for k, v in values.items():
        v = np.sort(v)
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            low, high = np.searchsorted(v, got[k][name], "left"), np.searchsorted(v, got[k][name], "right")
            assert low <= (share + 0.01) * len(v) + 1 and high >= (share - 0.01) * len(v) - 1
    late = rolling.merged_percentiles(sketches.filter(F.col("window_start") >= F.timestamp_seconds(F.lit(600))), "k").agg(F.sum("n")).first()[0]
    assert (late or 0) == sum(1 for i in range(n) if i * 7 >= 600)
