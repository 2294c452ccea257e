"""Hybrid search over chunks and over documents, as one lazy plan for a batch of queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, fusion, numbering, rolling, vector_search
from ..operators.inverted_index import InvertedIndex
from ..operators.vector_index import VectorIndex


def check_query(text: str | None, k: int, vector: list[float], dimension: int) -> None:
    """Blank text, then k, then the dimension."""
    if not (text or "").strip():
        raise ValueError("empty query")
    if k <= 0:
        raise ValueError("k must be positive")
    if len(vector) != dimension:
        raise ValueError(f"expected dimension {dimension}, got {len(vector)}")


def check_queries(queries: DataFrame, k: int, dimension: int | None = None) -> None:
    """The same for a batch of queries; dimension: of the vectors that they are compared with, none for an empty store."""
    if queries.filter(~T.has_text(F.col("text"))).limit(1).count():
        raise ValueError("empty query")
    if k <= 0:
        raise ValueError("k must be positive")
    if dimension is not None:
        wrong = queries.select(F.size("embedding").alias("n")).filter(F.col("n") != dimension).first()
        if wrong:
            raise ValueError(f"expected dimension {dimension}, got {wrong.n}")


def _checked(vectors: DataFrame, queries: DataFrame, k: int) -> None:
    first = vectors.select(F.size("embedding").alias("n")).filter("n >= 0").first()
    check_queries(queries, k, first.n if first else None)


def search_chunks(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, counts: bool = False, analyze: bm25.Analyzer = T.tokens) -> DataFrame:
    """query_id, rank, chunk_id, score, vector_score, keyword_score, text of the k best chunks.

    chunks: chunk_id, text; vectors: chunk_id, embedding; queries: query_id, text,
    embedding. 2k candidates from each side are fused by rank; the text is joined last.
    counts: also vector_count and keyword_count, the query's candidates on each side.
    """
    _checked(vectors, queries, k)
    near = vector_search.search(vectors.withColumnRenamed("chunk_id", "id"), queries, 2 * k)
    said = bm25.search(chunks.select(F.col("chunk_id").alias("id"), "text"), queries, 2 * k, analyze=analyze)
    return _hydrated(_fused_chunks(near, said, k, counts), chunks, counts)


def _fused_chunks(near: DataFrame, said: DataFrame, k: int, counts: bool) -> DataFrame:
    return fusion.fuse([near, said], k, scores=["vector_score", "keyword_score"], counts=["vector_count", "keyword_count"] if counts else [])


def _hydrated(fused: DataFrame, chunks: DataFrame, counts: bool = False) -> DataFrame:
    n = ["vector_count", "keyword_count"] if counts else []
    return fused.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id").select(
        "query_id", "rank", F.col("id").alias("chunk_id"), "score", F.greatest(F.lit(0.0), "vector_score").alias("vector_score"), "keyword_score", "text", *n
    )


def search_stored(keyword: InvertedIndex, vector: VectorIndex, queries: DataFrame, k: int, counts: bool = False, probes: int | None = None) -> DataFrame:
    """What search_chunks gives, from the stored indexes of a store's chunks and embeddings; texts are read from files that can hold a hit only.

    `probes`: lists a segment that the vector index asks, by default as many as its recall needs.
    """
    check_queries(queries, k, vector.width)
    fused = _fused_chunks(vector.search(queries, 2 * k, probes), keyword.search(queries, 2 * k), k, counts)
    fused = numbering.kept(fused)  # k rows a query: read for their ids, then joined
    return _hydrated(fused, keyword.catalog.matching(keyword.table, fused.select("id")), counts)


def search_with_timings(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, analyze: bm25.Analyzer = T.tokens) -> tuple[DataFrame, DataFrame]:
    """search_chunks with counts, one job a part, and one row of how long each took for the batch: n_queries, vector_ms,
    keyword_ms, fusion_ms, hydrate_ms, total_ms, and the candidates and results of all queries."""
    _checked(vectors, queries, k)
    spent, sizes = {}, {}

    def timed(name: str, df: DataFrame) -> DataFrame:
        began = time.monotonic()
        made = numbering.kept(df)
        sizes[name] = made.count()
        spent[f"{name}_ms"] = (time.monotonic() - began) * 1000
        return made

    near = timed("vector", vector_search.search(vectors.withColumnRenamed("chunk_id", "id"), queries, 2 * k))
    said = timed("keyword", bm25.search(chunks.select(F.col("chunk_id").alias("id"), "text"), queries, 2 * k, analyze=analyze))
    fused = timed("fusion", _fused_chunks(near, said, k, True))
    found = timed("hydrate", _hydrated(fused, chunks, True))
    row = (queries.count(), *(spent[f"{n}_ms"] for n in ("vector", "keyword", "fusion", "hydrate")), sizes["vector"], sizes["keyword"], sizes["hydrate"])
    schema = "n_queries long, vector_ms double, keyword_ms double, fusion_ms double, hydrate_ms double, vector_count long, keyword_count long, result_count long"
    return found, rolling.search_records(chunks.sparkSession.createDataFrame([row], schema))


def search_documents(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, analyze: bm25.Analyzer = T.tokens) -> DataFrame:
    """query_id, rank, doc_id, score, doc_keyword_score, best_chunk_score and chunks (nested) of the k best documents.

    documents: doc_id, text; chunks: chunk_id, document_id, text. The best of 4k chunks
    ranks a document by vector, 2k documents come by keyword; all chunks of a hit are
    returned, matched ones first. Chunks without a document take no part. The matched
    chunks travel with their document, so that each list is made once.
    """
    _checked(vectors, queries, k)
    near = vector_search.search(vectors.withColumnRenamed("chunk_id", "id"), queries, 4 * k).select("query_id", F.col("id").alias("chunk_id"), "score")
    owned = chunks.filter("document_id IS NOT NULL").select("chunk_id", "document_id")
    matched = F.map_from_entries(F.collect_list(F.struct("chunk_id", F.col("score").alias("s"))))
    lifted = near.join(owned, "chunk_id").groupBy("query_id", F.col("document_id").alias("id")).agg(F.max("score").alias("score"), matched.alias("matched"))
    by_vector = bm25.top_k(lifted, 2**31 - 1).withColumn("doc_keyword_score", F.lit(None).cast("double"))
    by_keyword = bm25.search(documents.select(F.col("doc_id").alias("id"), "text"), queries, 2 * k, analyze=analyze)
    by_keyword = by_keyword.select("query_id", "id", "rank", F.lit(None).cast(lifted.schema["matched"].dataType).alias("matched"), F.col("score").alias("doc_keyword_score"))
    both = by_vector.select("query_id", "id", "rank", "matched", "doc_keyword_score").unionByName(by_keyword)
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))), 10).alias("score"), F.first("matched", ignorenulls=True).alias("matched"), F.max("doc_keyword_score").alias("doc_keyword_score")
    )
    known = fused.join(documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    hits = bm25.top_k(known, k)
    placed = hits.join(owned.withColumnRenamed("document_id", "id"), "id", "left")
    vector_score = F.when(F.col("matched").isNotNull(), F.try_element_at("matched", F.col("chunk_id")))
    chunk = F.struct(vector_score.isNull().alias("unmatched"), (-F.coalesce(vector_score, F.lit(0.0))).alias("order"), "chunk_id", vector_score.alias("vector_score"))
    nested = placed.groupBy("query_id", "rank", "id", "score", "doc_keyword_score").agg(F.collect_list(F.when(F.col("chunk_id").isNotNull(), chunk)).alias("c"))
    in_order = F.transform(
        F.array_sort("c"),
        lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.coalesce(c["vector_score"], F.lit(0.0)).alias("score"), c["vector_score"].alias("vector_score")),
    )
    shown = F.when(F.size("c") > 0, in_order)
    return nested.withColumn("chunks", shown).select(
        "query_id", "rank", F.col("id").alias("doc_id"), "score", "doc_keyword_score", F.try_element_at("chunks", F.lit(1))["score"].alias("best_chunk_score"), "chunks"
    )


def page(results: DataFrame, offset: int, size: int) -> DataFrame:
    """Load more: the ranks behind offset, of results whose depth stays the same."""
    return results.filter((F.col("rank") > offset) & (F.col("rank") <= offset + size))
