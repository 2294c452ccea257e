"""Schemas of the store's tables, fixed in code; nothing is inferred."""

from __future__ import annotations

#: Version of the layout, and the oldest that can be read as it is.
SCHEMA_VERSION, MIN_COMPATIBLE_VERSION = 2, 1

DOCUMENTS = (
    "doc_id long, source_id string, title string, mime_type string, content_hash string, created_at long, "
    "updated_at long, char_count long, full_text string"
)
CHUNKS = "chunk_id long, document_id long, chunk_index int, text string, filename string, source string, created_at long, token_count long"
EMBEDDINGS = "chunk_id long, embedding array<float>"
SOURCES = "source_id string, content_hash string, version long, complete boolean"
QRELS = "query_id string, doc_id string, relevance int"
CORPUS_JSONL = "doc_id string, title string, text string"
QUERIES_JSONL = "query_id string, text string"

TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "sources": SOURCES}
KEYS = {"documents": "doc_id", "chunks": "chunk_id", "embeddings": "chunk_id", "sources": "source_id"}


def compatible(version: int) -> bool:
    return MIN_COMPATIBLE_VERSION <= version <= SCHEMA_VERSION


def needs_migration(version: int) -> bool:
    return version < SCHEMA_VERSION
