"""Readers: folders of files, JSON lines, judgments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def read_folder(spark: SparkSession, path: str, keep_binary: bool = False) -> DataFrame:
    """path, relative_path, content (string) of all files below path; binary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split(":")[-1].rstrip("/") + "/"
    rows = files.select("path", F.element_at(F.split("path", F.lit(root)), -1).alias("relative_path"), "content")
    if not keep_binary:
        rows = rows.filter(~T.is_binary(F.col("content")))
    return rows.withColumn("content", F.decode("content", "UTF-8"))


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.CORPUS_JSONL) -> DataFrame:
    """Blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_ids(spark: SparkSession, path: str) -> DataFrame:
    """The other layout, with _id: doc_id, title, text. A blank line is no record and fails the read like any bad one."""
    lines = spark.read.text(path)
    checked = F.when(T.has_text(F.col("value")), F.col("value")).otherwise(F.raise_error(F.lit("blank line")).cast("string"))
    row = F.from_json(checked, "_id string, title string, text string", {"mode": "FAILFAST"})
    return lines.select(row.alias("r")).select(F.col("r._id").alias("doc_id"), "r.title", "r.text")


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """kind (document, query), position, embedding of a cache file: three unsigned 64-bit numbers (documents, queries,
    dimension) and then all values as 32-bit floats, little-endian. A file of another length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                docs, queries, dimension = np.frombuffer(data, "<u8", 3).tolist() if len(data) >= 24 else (0, 0, 0)
                n = docs + queries
                if len(data) != 24 + 4 * n * dimension:
                    raise ValueError("not a cache of embeddings")
                values = pa.array(np.frombuffer(data, "<f4", n * dimension, 24))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), values)
                kinds = pa.array(["document"] * docs + ["query"] * queries)
                position = pa.array(np.concatenate([np.arange(docs), np.arange(queries)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([kinds, position, rows], names=["kind", "position", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "kind string, position long, embedding array<float>")


def read_qrels(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """query_id, doc_id, relevance. Without header: blank and # lines skipped, short lines an error. With: short lines
    are skipped, and of repeated pairs the last one counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    lines = lines.filter(T.has_text(F.col("value")) & ~F.col("value").startswith("#"))
    parts = lines.select("n", F.split("value", "\t").alias("p"), "value")
    if header:
        parts = parts.filter(~F.col("value").startswith("query-id") & (F.size("p") >= 3))
    else:
        parts = parts.filter(F.when(F.size("p") < 3, F.raise_error(F.concat(F.lit("short line: "), "value")).cast("boolean")).otherwise(True))
    rows = parts.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(1)).alias("doc_id"), F.get("p", F.lit(2)).cast("int").alias("relevance"), "n")
    if header:
        return rows.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "n").alias("relevance"))
    return rows.drop("n")
