"""Rolling figures and page indexing on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import rolling

#: A kind's samples are kept in so many states, so that one kind can have most of a stream.
SALTS = 8
SAMPLES = "array<struct<us: long, id: long, duration_ms: double>>"


def windowed(samples: DataFrame, by: str, window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """by, window_start, n, average on a stream (or batch) of samples: by, ts, duration_ms; state goes with the watermark."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), by)
    return grouped.agg(F.count("*").alias("n"), F.avg("duration_ms").alias("average")).select(by, F.col("window.start").alias("window_start"), "n", "average")


def index_pages(pages: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch of pages and its number to index.

    A batch that is repeated after a failure has the same number: plans.indexing.index_pages,
    given it as batch=(name, number), writes each batch once.
    """
    return pages.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(keep: int, window_s: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # no window can reach its samples any more
            state.remove()
            yield pd.DataFrame({"kind": [key[0]], "salt": [key[1]], "samples": [[]]})
            return
        us, ids, durations = map(np.array, state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for frame in frames:
            us, ids, durations = np.append(us, frame.us), np.append(ids, frame.id), np.append(durations, frame.duration_ms)
            last = np.lexsort((ids, us))[-keep:]
            us, ids, durations = us[last], ids[last], durations[last]
        state.update((us.tolist(), ids.tolist(), durations.tolist()))
        state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + window_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        rows = [{"us": a, "id": b, "duration_ms": c} for a, b, c in zip(us.tolist(), ids.tolist(), durations.tolist())]
        yield pd.DataFrame({"kind": [key[0]], "salt": [key[1]], "samples": [rows]})

    return run


def newest_states(samples: DataFrame, by: str, window_s: int, keep: int = rolling.NEWEST, late: str = "10 minutes", salts: int = SALTS) -> DataFrame:
    """A stream of kind, salt, samples: the newest `keep` of each kind and salt, again whenever they change.

    samples: a stream with by, id, ts, duration_ms. A timer empties a state whose samples are
    older than any window can be; what comes later than `late` is left out.
    """
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col(by).cast("string").alias("kind"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "ts", F.unix_micros("ts").alias("us"), "id", "duration_ms")
    return rows.groupBy("kind", "salt").applyInPandasWithState(
        _newest(keep, window_s), f"kind string, salt int, samples {SAMPLES}", "us array<long>, id array<long>, duration_ms array<double>", "update", GroupStateTimeout.EventTimeTimeout
    )


class Snapshots:
    """The last states of a stream as a table below `root`: one folder a batch, of which the last two stay.

    A folder holds all states, a bounded number of samples a kind. A batch that is repeated
    after a failure is written again from the folder before it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def _states(self, version: int | None) -> DataFrame:
        schema = f"kind string, salt int, samples {SAMPLES}"
        return self.spark.read.schema(schema).parquet(f"{self.root}/batch={version}") if version is not None else self.spark.createDataFrame([], schema)

    def write(self, states: DataFrame, number: int) -> None:
        """For foreachBatch."""
        versions = self._versions()
        before = self._states(max((v for v in versions if v < number), default=None))
        same = before.kind.eqNullSafe(states.kind) & (before.salt == states.salt)
        before.join(states, same, "left_anti").unionByName(states).write.mode("overwrite").parquet(f"{self.root}/batch={number}")
        for old in [v for v in versions if v < number][:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, by: str, window_s: int, keep: int = rolling.NEWEST) -> DataFrame:
        """What rolling.snapshot gives for all samples so far; a kind whose samples are all out of reach has none."""
        states = self._states(max(self._versions(), default=None))
        rows = states.select(F.col("kind").alias(by), F.explode_outer("samples").alias("s"))
        samples = rows.select(by, F.timestamp_micros("s.us").alias("ts"), "s.id", "s.duration_ms")
        return rolling.snapshot(samples, by, window_s, keep)


def keep_snapshots(samples: DataFrame, by: str, window_s: int, root: str, checkpoint: str, keep: int = rolling.NEWEST, late: str = "10 minutes"):
    """Start a stream that keeps the newest samples of each kind in Snapshots below root."""
    table = Snapshots(samples.sparkSession, root)
    states = newest_states(samples, by, window_s, keep, late)
    return states.writeStream.foreachBatch(table.write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
