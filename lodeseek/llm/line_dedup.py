"""Line dedup on levelled sorted runs of line hashes, DataFrame functions only.

A run is a table (key_a, key_b, n_docs, keep_doc), bucketed and sorted by the 128-bit hash
of a line key: one row per key, with the number of documents that hold it and the largest
doc_id among them, in this run and all before. Batches of documents arrive in descending
doc_id. Each batch is reduced to one row per key (map-side combined, so a line in a third
of all documents costs a row per task), which is the only shuffle; it is merge-anti-joined
with the runs, bucket by bucket and without shuffling or sorting them, to leave out keys whose
fate they settle already, takes over the counts of the others by merge joins, and is added
as a run of level 0. When a level holds `fanout` runs they are compacted, again bucket by
bucket, into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .common import ASCII_SPACE, CLEAN_SHUFFLES, ascii_lower, let, new_path, remove, settings, stage, text_of

KEY = ["key_a", "key_b"]
#: Spark's settings: a bucketed table of one file a bucket is read in its order; the largest number of buckets.
IN_ORDER, MAX_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.sources.bucketing.maxBuckets"


class LineRuns:
    """The levels of sorted runs. `add` takes batches in descending doc_id.

    A run has as many buckets as a shuffle has partitions, so that a batch comes out of
    its aggregation dealt like the runs. Runs are external tables of the session's catalog.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(MAX_BUCKETS)))
        self.levels: list[list[tuple[str, str]]] = []

    def add(self, occurrences: DataFrame) -> None:
        """occurrences: key_a, key_b, doc_id, first (true once for each key of a row)."""
        self._put(0, self.joined(occurrences))

    def joined(self, occurrences: DataFrame) -> DataFrame:
        """The batch's run."""
        run = occurrences.groupBy(*KEY).agg(F.count_if("first").alias("n_docs"), F.max("doc_id").alias("keep_doc"))
        for old in self._runs():
            settled = old.filter(F.col("n_docs") >= self.min_docs).toDF("old_a", "old_b", "old_n", "old_keep").hint("merge")
            # the last condition always holds: it keeps Catalyst from joining before the batch is aggregated
            same = (F.col("key_a") == F.col("old_a")) & (F.col("key_b") == F.col("old_b")) & (F.col("n_docs") > 0)
            run = run.join(settled, same, "left_anti")
        runs = self._runs()
        for i, old in enumerate(runs):
            run = run.join(old.toDF(*KEY, f"n_{i}", f"keep_{i}").hint("merge"), KEY, "left")
        if not runs:
            return run
        before = [F.coalesce(f"n_{i}", F.lit(0)) for i in range(len(runs))]
        keep = F.greatest("keep_doc", *[f"keep_{i}" for i in range(len(runs))])
        return run.select(*KEY, (F.col("n_docs") + (F.greatest(*before) if len(runs) > 1 else before[0])).alias("n_docs"), keep.alias("keep_doc"))

    def settled(self) -> DataFrame:
        """Keys in at least min_docs documents so far, each once, and the largest doc_id that holds them."""
        found = [r.filter(F.col("n_docs") >= self.min_docs).select(*KEY, "keep_doc") for r in self._runs()]
        return reduce(DataFrame.unionByName, found)

    def compacted(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: of a key's rows the newest has all documents."""
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.max("n_docs").alias("n_docs"), F.max("keep_doc").alias("keep_doc"))

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = new_path(self.spark, f"line-run-{level}")
        name = "lodeseek_" + path.rsplit("/", 1)[-1].replace("-", "_")
        with settings(self.spark, {IN_ORDER: "true", CLEAN_SHUFFLES: "true"}):
            run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:  # compaction
            old = self.levels[level]
            merged = self.compacted([self.spark.table(name) for name, _ in old])
            self.levels[level] = []
            self._put(level + 1, merged)
            self._drop(old)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has min_chars code points: doc_id, text_hash, position, key.

    `first` marks one of the lines of a document that share a key: sorted by key, the
    one that differs from its predecessor.
    """
    keys = F.transform(
        F.split(ascii_lower(F.col("text")), "\n", -1),
        lambda line, i: F.struct(F.btrim(line, F.lit(ASCII_SPACE)).alias("key"), i.alias("position")),
    )
    hashed = F.transform(
        F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars),
        lambda x: F.struct(
            F.xxhash64(x["key"]).alias("key_a"), F.xxhash64(F.lit(1), x["key"]).alias("key_b"), x["position"].alias("position")
        ),
    )
    marked = let(
        F.array_sort(hashed),
        lambda lines: F.transform(
            lines,
            lambda x, i: F.struct(
                x["key_a"].alias("key_a"),
                x["key_b"].alias("key_b"),
                x["position"].alias("position"),
                F.when(i == 0, True)
                .otherwise((F.get(lines, i - 1)["key_a"] != x["key_a"]) | (F.get(lines, i - 1)["key_b"] != x["key_b"]))
                .alias("first"),
            ),
        ),
    )
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(marked).alias("line")).select(
        "doc_id", "text_hash", "line.*"
    )


def _order_number(docs: DataFrame) -> Column:
    """A number that never falls as doc_id rises: itself, of a string its first seven bytes, of other types none (all rows are one batch)."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        return F.col("doc_id")
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode("doc_id", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.lit(None).cast("long")


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Drop lines that recur across documents, but for the copy in the largest doc_id.

    docs: doc_id, text and the columns named in keep; others are ignored. Returns
    doc_id, text (kept lines), n_lines, n_dropped and the columns in keep, a row for
    each row of docs.

    A line is what lies between two newlines; its key is the line stripped of ASCII
    white space with A-Z lower-cased. Null and empty texts are one empty line, never
    dropped. Each row is a document of its own: rows that repeat a doc_id count each,
    and all rows with the largest doc_id keep the line. A null doc_id sorts below all
    others; ids may be strings (by code point) or anything else that has an order. Keys are compared by two 64-bit hashes. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    extra = [F.col(c).alias(f"kept__{c}") for c in keep]
    docs = docs.select("doc_id", text_of().alias("text"), *extra)
    cuts = sorted(set(docs.agg(F.percentile_approx(_order_number(docs), [i / batches for i in range(1, batches)])).first()[0] or []), reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):  # the largest ids are batch 0; null, the last
        batch = F.when(_order_number(docs) > cut, i).otherwise(batch)
    lines = stage(_occurrences(docs, min_chars).withColumn("batch", batch), "lines", ["batch"])

    runs = LineRuns(spark, min_docs, fanout)
    for i in range(len(cuts) + 1):
        runs.add(lines.filter(F.col("batch") == i))
    settled = stage(runs.settled(), "settled-lines")
    runs.close()

    dropped = (
        lines.join(settled, KEY)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("position").alias("dropped"))
    )
    d = dropped.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "dropped")
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(
        d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left"
    )
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    left = let(
        F.split("text", "\n", -1),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")), lambda i: F.get(lines, i)), "\n"
        ),
    )
    return joined.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"kept__{c}").alias(c) for c in keep],
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, r, i, list_extract(ls, i) AS line,
         translate(trim(list_extract(ls, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keep_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT l.doc_id, l.r, l.i, l.line, c.key IS NOT NULL AND l.doc_id IS DISTINCT FROM c.keep_doc AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
