"""Words of whole columns of texts at once: split and numbered in Arrow, so that work is done once for each distinct word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are taken together up to so many bytes of text.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text, one row at least; nothing for no rows."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + size, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def split_distinct(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word in order, the distinct words in order of first appearance, and the words of each text.

    Words are what lies between ASCII white space; no word is empty. No text is null.
    """
    lists = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # white space at either end of a text
        real = number != empty
        text = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(text[real], minlength=len(sizes))
        number = number[real]
        number[number > empty] -= 1
        words = words.filter(pc.not_equal(words, pa.scalar("", words.type)))
    return number, words, sizes


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The same with the distinct words as bytes."""
    number, words, sizes = split_distinct(texts)
    return number, words.cast(pa.binary()).to_pylist(), sizes


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, empty ones too."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[ends] - sums[ends - sizes]


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Other 64-bit hashes for each salt (the splitmix64 finaliser)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 2**64 - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)
