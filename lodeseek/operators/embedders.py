"""Pluggable embedders: any function of a list of texts; a deterministic hash embedder for tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import cuts

BATCH = 64


def hash_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words and word pairs; a text without words has the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for feature in (*words, *map(" ".join, zip(words, words[1:]))):
                h = zlib.crc32(feature.encode())
                row[h % dimension] += 1 if h & 1 << 20 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def pooled_embedder(tokenizer, token_vectors: Callable[[list[int]], np.ndarray], max_length: int = 512, normalize: bool = True) -> Callable[[list[str]], np.ndarray]:
    """The mean of a model's vectors of a text's tokens, then unit length.

    tokenizer: of the tokenizers library; token_vectors: ids to an array (tokens,
    dimension), the last layer of any model. Each text is pooled over its own tokens
    alone, no padding. Ids are cut at max_length; a text without tokens is an error.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            ids = tokenizer.encode(text).ids[:max_length]
            if not ids:
                raise ValueError("a text without tokens")
            mean = np.asarray(token_vectors(ids), np.float64).mean(axis=0)
            norm = np.linalg.norm(mean) if normalize else 1.0
            out.append(mean / (norm if norm > 0 else 1.0))
        return np.stack(out) if out else np.zeros((0, 0))

    return embed


_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


def once(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A `load` that reads its model once a process, known by its name, and not once a task."""

    def cached() -> Callable[[list[str]], np.ndarray]:
        from lodeseek.operators import embedders  # this module in the worker, whose dictionary outlives the task

        if name not in embedders._loaded:
            embedders._loaded[name] = load()
        return embedders._loaded[name]

    return cached


def unload(name: str) -> None:
    """In this process; an error if it isn't loaded."""
    if name not in _loaded:
        raise KeyError(f"model {name} is not loaded")
    del _loaded[name]


def embed(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text") -> DataFrame:
    """docs and embedding. load is called once a task, where a model is read (see `once`); each text is embedded for itself."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for a, b in cuts(batch, rows=BATCH):
                rows = np.asarray(model([t or "" for t in batch.slice(a, b - a).to_pylist()]), np.float32)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel())))
            yield pa.concat_arrays(parts)

    return docs.withColumn("embedding", run(text))
