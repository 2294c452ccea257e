"""BM25 over documents that are scored where they lie, for a batch of queries.

score = sum over the query's distinct terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). One pass counts the documents of
each term asked for, one scores: a document's terms are met in its row, and each task sends on
only what can be among the k best, so that the shuffle doesn't grow with documents times queries.
`analyze` makes tokens of a text column: functions.text.tokens by default,
functions.stemming.english_tokens to find plurals and inflected forms too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import term_table

K1, B = 1.2, 0.75
Analyzer = Callable[[Column], Column]
#: Texts searched in one pass over the documents.
MAX_QUERIES = 10_000


def checked_queries(queries: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """The queries, if they are few enough to be broadcast."""
    n = queries.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} queries: search them in batches")
    return F.broadcast(queries)


def term_statistics(docs: DataFrame, analyze: Analyzer = T.tokens) -> DataFrame:
    """term, df, cf over docs (id, text)."""
    tf = docs.select("id", F.explode(analyze(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def alike(queries: DataFrame, analyze: Analyzer = T.tokens) -> DataFrame:
    """query_id, terms, first: the least query_id among those of the same distinct terms; queries without a term are left out."""
    terms = queries.select("query_id", F.array_sort(F.array_distinct(analyze(F.col("text")))).alias("terms")).filter(F.size("terms") > 0)
    return terms.withColumn("first", F.min("query_id").over(W.partitionBy("terms")))


def _best(shared, k: int, k1: float, b: float, mean: float):
    """From id and tokens: text and score of the texts for which a document can be among the k best; what the batch or the
    task has already beaten is left out."""

    @F.arrow_udf("array<struct<text: int, score: double>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table, idf = shared.value
        least = np.full(table.n_texts, -np.inf)

        def part(ids: pa.Array, tokens: pa.Array) -> pa.Array:
            n = len(ids)
            length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            doc, term, tf = table.met(tokens)
            worth = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
            place, text = table.asking(term)
            cell = text * n + doc[place]
            score = np.round(np.bincount(cell, weights=worth[place], minlength=table.n_texts * n), 10)
            present = np.zeros(len(score), bool)
            present[cell] = True
            score = np.where(present, score, -np.inf).reshape(table.n_texts, n)
            if n > k:
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                np.maximum(least, kth, out=least)
            text, doc = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            found = score[text, doc]
            place = np.empty(n, np.int64)
            place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(n)
            order = np.lexsort((place[doc], -found, text))  # of equal scores the smaller ids
            of = np.bincount(text, minlength=table.n_texts)
            keep = order[np.arange(len(order)) - np.repeat(np.cumsum(of) - of, of) < k]
            keep = keep[np.argsort(doc[keep], kind="stable")]
            return term_table.lists(n, doc[keep], ["text", "score"], [pa.array(text[keep].astype(np.int32)), pa.array(found[keep])])

        for ids, tokens in batches:
            step = table.rows()
            parts = [part(ids.slice(i, step), tokens.slice(i, step)) for i in range(0, len(ids), step)]
            yield pa.concat_arrays(parts) if parts else term_table.lists(0, np.zeros(0, np.int64), ["text", "score"], [pa.array([], pa.int32()), pa.array([], pa.float64())])

    # what it gives depends on the rows before: else Spark runs it a second time beneath a join, over rows that the join leaves out
    return run.asNondeterministic()


def _search_texts(docs: DataFrame, texts: DataFrame, k: int, k1: float, b: float, average: float | None, analyze: Analyzer) -> DataFrame:
    """first, id, score, rank for texts (first, terms), few enough to travel to every task."""
    spark = docs.sparkSession
    asked = sorted(map(tuple, texts.collect()))  # bounded by the caller
    table = term_table.TermTable([terms for _, terms in asked])
    tokens = docs.select("id", analyze(F.col("text")).alias("tokens"))
    # a null term for each document carries its length, so that one pass gives all figures
    each = tokens.select(F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("tokens"), F.array()))).alias("term"))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [None, *table.names.to_pylist()]], "wanted string"))  # terms of a bounded batch
    counted = each.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi").groupBy("term").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("term").isNull(), F.col("length"))).alias("sized"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("total")
    )
    figures = {r.term: r for r in counted.collect()}  # a row a term that was asked for
    whole = figures.get(None)
    n_docs, mean = (whole.n, whole.total / whole.sized if whole.sized else 1.0) if whole else (0, 1.0)
    df = np.array([figures[t].n if t in figures else 0 for t in table.names.to_pylist()], np.float64)
    shared = spark.sparkContext.broadcast((table, np.log(1 + (n_docs - df + 0.5) / (df + 0.5))))
    mean = float(average if average is not None else mean) or 1.0
    found = tokens.select("id", _best(shared, max(k, 1), k1, b, mean)("id", "tokens").alias("found")).select("id", F.explode("found").alias("f"))
    ranked = top_k(found.select(F.col("f.text").alias("query_id"), "id", "f.score"), k)
    firsts = spark.createDataFrame([(i, first) for i, (first, _) in enumerate(asked)], f"text int, first {texts.schema['first'].dataType.simpleString()}")
    return ranked.join(F.broadcast(firsts), F.col("query_id") == F.col("text")).select("first", "id", "score", "rank")  # a row a text


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: best first, ties to the smaller id; cut before the shuffle as well."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, average: float | None = None, analyze: Analyzer = T.tokens) -> DataFrame:
    """query_id, id, score, rank of the k best documents of each query. docs: id, text; queries: query_id, text.

    Queries with the same terms are searched once; more texts than travel to a task at once
    (MAX_QUERIES, or 100 times as many terms) are searched in several passes.
    """
    asked = alike(queries, analyze)
    texts = asked.select("first", "terms").dropDuplicates(["first"])
    n, n_terms = texts.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    passes = max(1, -(-n // MAX_QUERIES), -(-n_terms // (100 * MAX_QUERIES)))
    of = F.pmod(F.xxhash64("first"), F.lit(passes))
    found = reduce(DataFrame.unionByName, [_search_texts(docs, texts.filter(of == i), k, k1, b, average, analyze) for i in range(passes)])
    return asked.select("query_id", "first").join(found, "first").select("query_id", "id", "score", "rank")
