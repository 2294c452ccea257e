"""Ids of texts by a tokenizer file, special tokens included, cut at a length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.slices import cuts


def tokenize(docs: DataFrame, tokenizer_path: str, max_length: int = 512) -> DataFrame:
    """id, ids (array<int>). docs: id, text; a blank text is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_length)
        for whole in batches:
            for a, b in cuts(whole.column(1)):
                batch = whole.slice(a, b - a)
                # a text at a time: the library keeps what it cuts off until the ids are taken
                ids = [tokenizer.encode(text).ids for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    checked = F.when(~T.has_text(F.col("text")), F.raise_error(F.lit("empty text")).cast("string")).otherwise(F.col("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", checked.alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
