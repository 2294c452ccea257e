"""Terms of a batch of texts that travel to every task and meet each document where it lies.

A document is a row, so the terms that it shares with the batch are counted within the row
and no posting is shuffled; what is sent on are only the rows that a caller keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Cells of a table of documents by texts that is worked on at a time.
CELLS = 1_000_000


class TermTable:
    """The distinct terms of texts, which are numbered as they come."""

    def __init__(self, texts: list[list[str]]):
        names = sorted({t for terms in texts for t in terms})
        number = {t: i for i, t in enumerate(names)}
        pairs = np.array(sorted((number[t], i) for i, terms in enumerate(texts) for t in set(terms)), np.int64).reshape(-1, 2)
        self.names, self.n_texts = pa.array(names, pa.string()), len(texts)
        self.texts = pairs[:, 1]
        self.uses = np.bincount(pairs[:, 0], minlength=len(names))
        self.first = np.cumsum(self.uses) - self.uses

    def rows(self) -> int:
        """Documents to work on at a time."""
        return max(16, CELLS // max(1, self.n_texts))

    def met(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For lists of tokens: document, term and how often it holds it, in order of both."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        found = pc.index_in(tokens.flatten(), value_set=self.names)
        here = pc.is_valid(found).to_numpy(zero_copy_only=False)
        code = np.repeat(np.arange(len(tokens)), sizes)[here] * max(1, len(self.names)) + found.drop_null().to_numpy().astype(np.int64)
        code, times = np.unique(code, return_counts=True)
        return code // max(1, len(self.names)), code % max(1, len(self.names)), times

    def pieces(self, doc: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
        """From and to of whole documents, of which about CELLS terms of texts and cells of a table are worked on at a time; one document at least."""
        ends, at, most = np.cumsum(self.uses[term]), 0, max(1, CELLS // max(1, self.n_texts))
        while at < len(doc):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right"))
            to = int(np.searchsorted(doc, min(doc[to] if to < len(doc) else doc[-1] + 1, doc[at] + most)))
            to = max(to, int(np.searchsorted(doc, doc[at], side="right")))
            yield at, to
            at = to

    def asking(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place in terms as often as texts have that term, and those texts."""
        uses = self.uses[terms]
        place = np.repeat(np.arange(len(terms)), uses)
        within = np.arange(len(place)) - np.repeat(np.cumsum(uses) - uses, uses)
        return place, self.texts[self.first[terms[place]] + within]


def lists(n: int, doc: np.ndarray, names: list[str], columns: list[pa.Array]) -> pa.Array:
    """A list of structs for each of n documents; doc: of each struct, in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=names))


def counted():
    """A function of a column of lists of tokens: term and tf of the distinct ones."""

    @F.arrow_udf("array<struct<term: string, tf: long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            coded = tokens.flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            code, tf = np.unique(np.repeat(np.arange(len(tokens)), sizes) * many + coded.indices.to_numpy(), return_counts=True)
            terms = coded.dictionary.take(pa.array(code % many))
            yield lists(len(tokens), code // many, ["term", "tf"], [terms, pa.array(tf.astype(np.int64))])

    return run.asNondeterministic()  # else Spark counts twice: beneath a join, to leave out empty lists, and above it
