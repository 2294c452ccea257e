"""Indexing a batch of files or pages as one job: hash, compare, chunk only what is new or changed, embed, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import chunking, crawl, embedders, lifecycle, numbering
from ..sources.catalog import Catalog


def index_files(
    catalog: Catalog, files: DataFrame, load_embedder, now: int, most: int = chunking.MAX_TOKENS, tokenizer_path: str | None = None, batch: tuple[str, int] | None = None
) -> DataFrame:
    """files: source_id, path, text. Returns source_id, action. Skipped files are neither chunked nor embedded.

    What a batch writes, and what of the sources it reads, grows with the batch, not with
    the store. Sources are recorded as incomplete before their rows are written and as
    complete after, so that a job that dies half-way leaves nothing that a load would show.
    Ids are reserved by commits, so jobs side by side get different ones. `batch` (a
    stream's name and a number) goes into the last commit: a batch that is handed over
    again after it changes nothing and returns no rows.
    """
    if batch and catalog.seen("sources", batch):
        return catalog.spark.createDataFrame([], "source_id string, action string")
    hashed = files.filter(T.has_text(F.col("text"))).withColumn("content_hash", T.content_hash(F.col("text")))
    incoming = numbering.kept(hashed.select("source_id", "content_hash"))
    known = catalog.matching("sources", incoming.select("source_id")).withColumn("chunk_count", F.lit(0))
    plan = numbering.kept(lifecycle.change_plan(incoming, known).select("source_id", "action"))
    todo = hashed.join(plan.filter("action <> 'skip'").select("source_id"), "source_id", "left_semi")
    record = todo.select("source_id", "content_hash", F.lit(1).cast("long").alias("version"), F.lit(False).alias("complete"))
    record = numbering.kept(record)
    # only a source that the store knows, complete or not, can have rows
    replaced = numbering.kept(catalog.matching("sources", record.select("source_id")).select("source_id"))
    catalog.upsert("sources", record)
    if not replaced.isEmpty():
        documents, chunks = catalog.scan("documents"), catalog.scan("chunks")
        old_docs = numbering.kept(documents.join(replaced, "source_id", "left_semi").select("doc_id"))
        old_chunks = numbering.kept(chunks.join(old_docs.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi").select("chunk_id"))
        for table, keys in (("documents", old_docs), ("chunks", old_chunks), ("embeddings", old_chunks)):
            if not keys.isEmpty():
                catalog.delete(table, keys)

    first_doc = catalog.reserve("documents", record.count())
    numbered = numbering.kept(numbering.number(todo, ["source_id"], "doc_id", first_doc))
    stored = numbered.select(
        "doc_id", "source_id", F.col("path").alias("title"), F.lit(None).cast("string").alias("mime_type"), "content_hash",
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.octet_length("text").cast("long").alias("char_count"), F.col("text").alias("full_text"),
    )
    pieces = chunking.chunks(numbered.select(F.col("doc_id").alias("id"), "path", "text"), most, tokenizer_path)
    pieces = numbering.kept(pieces.join(numbered.select(F.col("doc_id").alias("id"), "path", "source_id"), "id"))
    first_chunk = catalog.reserve("chunks", pieces.count())
    pieces = numbering.kept(numbering.number(pieces, ["id", "chunk_index"], "chunk_id", first_chunk))
    chunk_rows = pieces.select(
        "chunk_id", F.col("id").alias("document_id"), "chunk_index", "text", T.chunk_label(F.col("path"), F.col("chunk_index")).alias("filename"),
        F.col("source_id").alias("source"), F.lit(now).alias("created_at"), "token_count",
    )
    catalog.append("documents", stored)
    catalog.append("chunks", chunk_rows)
    catalog.append("embeddings", embedders.embed(pieces, load_embedder).select("chunk_id", "embedding"))
    catalog.upsert("sources", record.withColumn("complete", F.lit(True)), batch=batch)
    return plan


def page_files(pages: DataFrame) -> DataFrame:
    """source_id, path, text of pages (url, html) that hold text."""
    parsed = pages.select("url", html.extract("html", "url")["text"].alias("text"))
    return parsed.filter(T.has_text(F.col("text"))).select(F.concat(F.lit("web:"), "url").alias("source_id"), F.col("url").alias("path"), "text")


def index_pages(catalog: Catalog, pages: DataFrame, load_embedder, now: int, most: int = chunking.MAX_TOKENS, batch: tuple[str, int] | None = None) -> DataFrame:
    """index_files for pages: url, html, and success (optional: only those count)."""
    if "success" in pages.columns:
        pages = pages.filter("success")
    return index_files(catalog, page_files(pages.dropDuplicates(["url"])), load_embedder, now, most, batch=batch)


def crawl_and_index(catalog: Catalog, pages: DataFrame, start: list[str], max_depth: int, load_embedder, now: int, max_pages: int | None = None, scope: str | None = None) -> DataFrame:
    """Crawl the table of pages and index what is reached; source_id, action."""
    reached = crawl.crawl(crawl.links(pages), start, max_depth, max_pages, scope).select(F.col("url").alias("_reached"))
    found = pages.join(reached, T.normalize_url(F.col("url")) == F.col("_reached"), "left_semi")
    return index_pages(catalog, found, load_embedder, now)
