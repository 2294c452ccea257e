"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph, which is cut into partitions of
equal size, whose number grows with the table; a small classifier learns a vector's
partition and those of its neighbours. Every row is indexed in its most probable
partition, a query goes to the most probable ones, as many as a held-out part of the
sample needs for the recall aimed at, and to all where those hold too few other vectors.
Within a partition, blocks of queries meet blocks of rows, each of bounded size, in double
precision. Equal vectors are indexed once, with their smallest ids. Vectors can be compared
only with those of their own length: those of the commonest length are routed, those of
each other length are a partition of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, one_blas_thread, stage

#: Distinct vectors a partition should hold, and the most partitions; larger tables have larger ones.
PARTITION_ROWS, MOST_PARTITIONS = 512, 1024
#: The sample that the graph and the classifier are fitted on: so many vectors, or so many a partition, within so many bytes;
#: and the part of it held out to choose the number of probes.
SAMPLE, SAMPLE_A_PARTITION, SAMPLE_BYTES, HELD_OUT = 12_000, 64, 64_000_000, 1_000
NEIGHBOURS, HIDDEN, EPOCHS, RECALL = 10, 96, 30, 0.94
#: Vectors to learn from that a partition needs; with fewer there are fewer partitions.
LEARN_A_PARTITION = 8
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest others of each unit vector, nearest first."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64)
        out[i : i + len(s)] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """Cut the graph into equal parts: halving along principal directions, then moves to where most neighbours are, within a capacity."""
    n = len(x)
    part = np.zeros(n, np.int64)
    split = [np.arange(n)]
    while len(split) < parts:
        halves = []
        for rows in split:
            centred = x[rows] - x[rows].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = rows[np.argsort(centred @ direction, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        split = halves
    for p, rows in enumerate(split):
        part[rows] = p
    room = int(np.ceil(n / parts * slack))
    links = np.concatenate([np.repeat(np.arange(n), graph.shape[1])[:, None], graph.reshape(-1, 1)], axis=1)
    links = np.concatenate([links, links[:, ::-1]])
    for _ in range(rounds):
        votes = np.zeros((n, len(split)), np.int32)
        np.add.at(votes, (links[:, 0], part[links[:, 1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=len(split))
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
    return part


@dataclass
class Router:
    """One hidden layer; probabilities of partitions, as logits."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7) -> Router:
    """Adam on the cross entropy with the target distribution over partitions."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            rows = order[i : i + 256]
            a = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = a @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            da = dz @ w[2].T * (a > 0)
            t += 1
            for j, g in enumerate((x[rows].T @ da, da.sum(axis=0), a.T @ dz, dz.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] -= 0.002 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def partitions_for(n: int) -> int:
    """A power of two, of about PARTITION_ROWS rows each."""
    return min(MOST_PARTITIONS, 1 << max(0, round(math.log2(max(n, 1) / PARTITION_ROWS))))


def fit_router(x: np.ndarray, parts: int, k: int = 5, recall: float = RECALL) -> Router:
    """The router of a sample of unit vectors, with the probes that its held-out vectors need."""
    held = min(HELD_OUT, len(x) // 4)
    learn = x[held:]
    while parts > 1 and len(learn) < LEARN_A_PARTITION * parts:  # fewer, larger partitions, as many as can be learnt
        parts //= 2
    if parts <= 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(learn, NEIGHBOURS)
    part = balanced_partition(learn, graph, parts)
    target = np.zeros((len(learn), parts))
    np.add.at(target, (np.arange(len(learn)), part), 1 + graph.shape[1] / 2)
    np.add.at(target, (np.repeat(np.arange(len(learn)), graph.shape[1]), part[graph].ravel()), 1)
    router = train_router(learn, target / target.sum(axis=1, keepdims=True))
    home = router.ranked(learn)[:, 0]
    near = np.argsort(-(x[:held] @ learn.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(router.ranked(x[:held]), axis=1, kind="stable")  # rank of each partition for each query
    found = np.take_along_axis(place, home[near], 1)
    reached = [(found < probes).mean() for probes in range(1, parts + 1)]
    router.probes = next((i + 1 for i, r in enumerate(reached) if r >= recall), parts)
    return router


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _route(router, width: int, most: int | None):
    """rep, embedding and the most probable partitions of each; vectors of another length than width go to that of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        model = router.value
        for whole in batches:
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False)
            other = whole.filter(pa.array(sizes != width))
            if other.num_rows:
                parts = pa.array(-sizes[sizes != width], pa.int32())
                yield pa.RecordBatch.from_arrays([*other.columns, parts], names=["rep", "embedding", "part"])
            batch = whole.filter(pa.array(sizes == width))
            if not batch.num_rows:
                continue
            n = most or model.probes
            ranked = model.ranked(_unit(_matrix(batch.column(1))))[:, :n].astype(np.int32)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), ranked.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ranked.ravel())], names=["rep", "embedding", "part"]
            )

    return run


def _compare(keep: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        one_blas_thread()
        mine, queries = group[~group.is_query], group[group.is_query]
        if mine.empty or queries.empty:
            return pd.DataFrame({"query_rep": [], "rep": [], "score": []}).astype({"query_rep": "int64", "rep": "int64"})
        # double precision throughout, on the original vectors
        rows, asked = (np.stack(g.embedding.to_list()).astype(np.float64) for g in (mine, queries))
        score = (asked @ rows.T) / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1))
        ids = mine.rep.to_numpy()
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :keep]
        return pd.DataFrame(
            {
                "query_rep": np.repeat(queries.rep.to_numpy(), order.shape[1]),
                "rep": ids[order].ravel(),
                "score": np.take_along_axis(score, order, 1).ravel(),
            }
        )

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, as doubles."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def search(vectors: DataFrame, query_every: int = 50, k: int = 5, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by query_every.

    vectors: vec_id, embedding; other columns are ignored. Candidates are all rows of the
    query's length but its own; score is the cosine in double precision; ties go to the
    smaller vec_id; with fewer candidates, all of them. Vectors that are null, empty or
    zero or hold null or non-finite components take no part, nor do rows without a vec_id
    and rows that repeat another. parts: partitions, by default as the table needs. An
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors)
    classes = stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep")), "vector-classes")
    by_id = W.partitionBy("embedding").orderBy("vec_id")
    distinct = valid.withColumn("n", F.dense_rank().over(by_id)).filter(F.col("n") <= k + 1).select("vec_id", "embedding").distinct()
    members = stage(distinct.join(classes, "embedding").select("rep", "vec_id"), "vector-members")
    asked = valid.filter(F.col("vec_id") % query_every == 0)
    queries = stage(asked.join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query_rep")).distinct(), "vector-queries")

    commonest = classes.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = commonest if commonest else (0, 0)
    parts = parts or partitions_for(n)
    drawn = min(max(SAMPLE, SAMPLE_A_PARTITION * parts), max(SAMPLE_BYTES // (4 * max(width, 1)), 1))
    largest = F.array_max(F.transform("embedding", F.abs))
    single = F.transform("embedding", lambda x: (x / largest).cast("float")).alias("embedding")
    sample = classes.filter(F.size("embedding") == width).orderBy(F.xxhash64("rep"), "rep").limit(drawn).select(single).toArrow()  # bounded
    x = _unit(_matrix(sample.column("embedding").combine_chunks())).astype(np.float32) if sample.num_rows else np.zeros((0, 1), np.float32)
    router = fit_router(x, parts, k, recall)
    model = spark.sparkContext.broadcast(router)
    schema = "rep long, embedding array<double>, part int"
    columns = ["rep", "embedding"]
    rows = stage(classes.select(*columns).mapInArrow(_route(model, width, 1), schema), "vector-index")
    wanted = classes.join(queries.select(F.col("query_rep").alias("rep")).distinct(), "rep", "left_semi")
    probes = stage(wanted.select(*columns).mapInArrow(_route(model, width, None), schema), "vector-probes")

    def answers(probes: DataFrame, name: str) -> DataFrame:
        """query_id, query_rep, near: up to k nearest others in the partitions probed."""
        counts = spark.createDataFrame(
            [
                (p, -(-n // BLOCK_ROWS), -(-m // BLOCK_QUERIES))
                for p, n, m in rows.groupBy("part").count().join(probes.groupBy("part").agg(F.count("*").alias("asked")), "part").collect()
            ],
            "part int, row_blocks int, query_blocks int",
        )  # a row for each partition

        def dealt(side: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
            block = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias(own)
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
            placed = side.join(F.broadcast(counts), "part").select("rep", "embedding", "part", block, every)
            return placed.select("rep", "embedding", "part", "row_blocks", "query_blocks", F.lit(is_query).alias("is_query"))

        met = dealt(rows, "row_blocks", "query_blocks", False).unionByName(dealt(probes, "query_blocks", "row_blocks", True))
        found = met.groupBy("part", "row_blocks", "query_blocks").applyInPandas(_compare(k + 1), "query_rep long, rep long, score double")
        best = W.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
        nearest = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query_rep", "rep", "score")
        nearest = stage(nearest, f"{name}-nearest")
        expanded = nearest.join(members, "rep")
        best = W.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
        lists = (
            expanded.withColumn("n", F.row_number().over(best))
            .filter(F.col("n") <= k + 1)
            .groupBy("query_rep")
            .agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
        )
        others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
        lists = stage(lists, f"{name}-answers")
        discard(nearest)
        return queries.join(lists, "query_rep").select("query_id", "query_rep", others.alias("near"))

    answered = answers(probes, "vector")
    if router.probes < len(router.out_bias):
        full = answered.filter(F.size("near") >= k).select("query_id")
        routed = classes.filter(F.size("embedding") == width).select(F.col("rep").alias("query_rep"))
        short = queries.join(full, "query_id", "left_anti").join(routed, "query_rep", "left_semi")
        short = stage(short.select(F.col("query_rep").alias("rep")).distinct(), "vector-short")
        if not short.isEmpty():  # few rows where these queries look: they look everywhere
            again = classes.filter(F.size("embedding") == width).join(short, "rep", "left_semi").select(*columns).mapInArrow(_route(model, width, len(router.out_bias)), schema)
            rest = answered.join(short.toDF("query_rep"), "query_rep", "left_anti").select(*answered.columns)
            answered = rest.unionByName(answers(stage(again, "vector-further-probes"), "vector-further"))
    for table in (classes, members, rows, probes):
        discard(table)
    answered = answered.select("query_id", F.posexplode("near").alias("at", "c"))
    return answered.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
