"""Rows of the store by key, and the life of sources: changes, deletes, compaction, load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a batch read are broadcast; more than this must come as a table.
MAX_KEYS = 100_000
COMPACTION_RATIO = 0.30


def point_get(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def batch_get(table: DataFrame, key: str, values: list) -> DataFrame:
    """Found rows in the order of values, missing ones dropped; column `position`."""
    if len(values) > MAX_KEYS:
        raise ValueError(f"at most {MAX_KEYS} keys")
    kind = table.schema[key].dataType.simpleString()
    wanted = table.sparkSession.createDataFrame(list(enumerate(values)), f"position int, wanted {kind}")
    return table.join(F.broadcast(wanted), F.col(key) == F.col("wanted")).drop("wanted").orderBy("position")


def newest_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last by `order` (ties, and without one, the largest row), so that reruns agree."""
    whole = F.struct(*([order] if order else []), *[c for c in rows.columns if c != order])
    picked = rows.groupBy(key).agg(F.max(whole).alias("_row"))
    return picked.select("_row.*").select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """rows replace those of table with the same key; of repeated keys within rows the last by `order` wins (a column of both)."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(newest_of(rows, key, order))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def needs_update(old_hash: Column, new_hash: Column) -> Column:
    return ~old_hash.eqNullSafe(new_hash)


def change_plan(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, action (add, skip, update) and the chunks that an update replaces.

    incoming: source_id, content_hash; sources: source_id, content_hash, chunk_count, complete.
    Incomplete sources count as absent.
    """
    known = sources.filter("complete").select("source_id", F.col("content_hash").alias("old_hash"), F.col("chunk_count").alias("old_chunks"))
    joined = incoming.join(known, "source_id", "left")
    action = F.when(F.col("old_hash").isNull(), "add").when(F.col("old_hash") == F.col("content_hash"), "skip").otherwise("update")
    return joined.select(
        "source_id", action.alias("action"), F.when(action == "update", F.col("old_chunks")).otherwise(F.lit(0)).cast("long").alias("replaced_chunks")
    )


def delete_source(tables: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without these sources: their documents, chunks, embeddings and records."""
    documents = tables["documents"].join(source_ids, "source_id", "left_semi").select(F.col("doc_id").alias("document_id"))
    chunks = tables["chunks"].join(documents, "document_id", "left_semi").select("chunk_id")
    return {
        "documents": delete(tables["documents"], source_ids, "source_id"),
        "chunks": delete(tables["chunks"], chunks, "chunk_id"),
        "embeddings": delete(tables["embeddings"], chunks, "chunk_id"),
        "sources": delete(tables["sources"], source_ids, "source_id"),
    }


def live(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    return chunks.join(deleted.select("chunk_id"), "chunk_id", "left_anti")


def compaction_stats(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """total, deleted, ratio (0 for no rows), needed (ratio strictly above the limit)."""
    marked = chunks.select("chunk_id").join(deleted.select("chunk_id", F.lit(1).alias("gone")), "chunk_id", "left")
    counted = marked.agg(F.count("*").alias("total"), F.count("gone").alias("deleted"))
    ratio = F.coalesce(F.try_divide("deleted", "total"), F.lit(0.0))
    return counted.select("total", "deleted", ratio.alias("ratio"), (ratio > COMPACTION_RATIO).alias("needed"))


def compacted(chunks: DataFrame, deleted: DataFrame, force: bool = False) -> DataFrame:
    """The chunks without the deleted ones where that is needed, or with force; else as they are."""
    stats = compaction_stats(chunks, deleted).first()
    return live(chunks, deleted) if stats.needed or force and stats.deleted else chunks


def dump(chunks: DataFrame, embeddings: DataFrame, deleted: DataFrame, n: int = 10, preview: int = 100) -> str:
    """Figures of the index and its first chunks, for people; chunks: chunk_id, filename, source, text."""
    figures = compaction_stats(chunks, deleted).first()
    dimension = embeddings.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    lines = [f"chunks: {figures.total}", f"deleted: {figures.deleted}", f"vectors: {embeddings.count()}", f"dimension: {dimension}"]
    for r in live(chunks, deleted).orderBy("chunk_id").limit(n).collect():
        text = r.text or ""
        lines += [f"[{r.chunk_id}] {r.filename} ({r.source})", "  " + (text if len(text) <= preview else text[:preview] + "...")]
    return "\n".join(lines if figures.total else [*lines, "no chunks"])


class NotFound(LookupError):
    """A source that isn't registered."""


def register(source_id: str, content_hash: str, spark) -> DataFrame:
    """The record of a source whose rows are still to come."""
    return spark.createDataFrame([(source_id, content_hash, 1, False)], "source_id string, content_hash string, version long, complete boolean")


def complete(sources: DataFrame, source_id: str) -> DataFrame:
    """The record, complete now; an error if there is none."""
    found = point_get(sources, "source_id", source_id)
    if not found.limit(1).count():
        raise NotFound(source_id)
    return found.withColumn("complete", F.lit(True))


def load(tables: dict[str, DataFrame], dimension: int) -> dict[str, DataFrame]:
    """What a search may see: incomplete sources purged first, then chunks with an embedding of the right dimension."""
    incomplete = tables["sources"].filter("NOT complete").select("source_id")
    purged = delete_source(tables, incomplete)
    purged["embeddings"] = purged["embeddings"].filter(F.size("embedding") == dimension).join(purged["chunks"].select("chunk_id"), "chunk_id", "left_semi")
    return purged


def index_metrics(chunks: DataFrame) -> DataFrame:
    """n_docs, n_chunks, n_tokens, tokens_per_chunk (0 for none); chunks: document_id, token_count."""
    counted = chunks.agg(
        F.countDistinct("document_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("n_tokens")
    )
    return counted.withColumn("tokens_per_chunk", F.coalesce(F.try_divide("n_tokens", "n_chunks"), F.lit(0.0)))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_ids in order, chunk_count."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"])
    return chunks.filter("document_id IS NOT NULL").groupBy("document_id").agg(ordered.alias("chunk_ids"), F.count("*").alias("chunk_count"))


def reassemble(chunks: DataFrame, key: str, order: Column) -> DataFrame:
    """key, text: its chunks in order (ties and gaps by text), with a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("n"), F.col("text"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def manifest(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, version: int) -> DataFrame:
    """One row of what the store holds: version, counts, tokens, dimension (0 for none)."""
    d = documents.agg(F.count("*").alias("n_docs"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("modified_at"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("n_tokens"))
    e = embeddings.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
    return d.crossJoin(c).crossJoin(e).select(F.lit(version).alias("version"), "*")  # a row each


def reduced_tokens(total: Column, removed: Column) -> Column:
    return F.greatest(total - removed, F.lit(0))
