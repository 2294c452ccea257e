"""A stored vector index: inverted lists for each segment of the store.

A segment's lists are the cells of unit centroids that are fitted on a bounded sample of it;
every row is in the list of its nearest centroid, and the lists are written in order. A search
finds each query's nearest lists in each segment, as many as a held-out part of the sample
needed for the recall aimed at, and compares it with the live rows of those alone; the best of
all segments are merged. Ranking is by the cosine, in double precision, as in vector_search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Segment
from . import bm25, vector_search
from .segment_index import SegmentIndex

#: Rows a list should hold and the most lists of a segment; vectors of the sample a list, and its bytes at most.
LIST_ROWS, MOST_LISTS, SAMPLE_A_LIST, SAMPLE_BYTES = 256, 4096, 64, 64_000_000
#: Vectors of the sample that are held out to choose the number of lists probed, the recall aimed at, rounds of fitting.
HELD_OUT, RECALL, NEAREST, ROUNDS = 400, 0.97, 10, 12
LISTS = "list int, id long, _pos long, embedding array<float>"
CENTROIDS = "list int, n long, probes int, centroid array<float>"


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its cosine, in blocks of bounded size."""
    cell, near = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    step = max(1, vector_search.CELLS // len(centroids))
    for i in range(0, len(rows), step):
        part = rows[i : i + step] @ centroids.T
        cell[i : i + step] = part.argmax(axis=1)
        near[i : i + step] = part.max(axis=1)
    return cell, near


def fit_lists(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cell takes the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        cell, near = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.bincount(cell, minlength=lists) == 0
        if empty.any():
            sums[empty] = sample[np.argsort(near)[: empty.sum()]]
        centroids = unit(sums)
    return centroids


def probes_needed(sample: np.ndarray, centroids: np.ndarray, aim: float = RECALL) -> int:
    """The lists that the last HELD_OUT vectors of the sample need to find `aim` of their nearest others in it."""
    n = max(1, min(HELD_OUT, len(sample) // 4))
    k = min(NEAREST, len(sample) - 1)
    if k < 1:
        return len(centroids)
    cell, places = nearest(sample, centroids)[0], []
    step = max(1, vector_search.CELLS // len(sample))
    for i in range(len(sample) - n, len(sample), step):
        asked = sample[i : i + step]
        near = asked @ sample.T
        near[np.arange(len(asked)), np.arange(i, i + len(asked))] = -np.inf
        found = cell[np.argpartition(-near, k - 1, axis=1)[:, :k]]
        order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        places.append(np.take_along_axis(rank, found, axis=1).ravel())
    place = np.sort(np.concatenate(places))
    return int(place[max(0, int(np.ceil(aim * len(place))) - 1)]) + 1


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(unit(rows), centroids)[0].astype(np.int32)), *batch.columns], names=["list", "id", "_pos", "embedding"])

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, asking = shared.value
        best = vector_search.Best(query_ids, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            rows = unit(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            coded = batch.column(0).dictionary_encode()
            segment, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            cuts = np.flatnonzero(np.diff(segment) | np.diff(lists)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)]):
                bits = asking.get((names[segment[a]], int(lists[a])))
                if bits is not None:
                    best.compare(matrix, rows[a:b], ids[a:b], np.flatnonzero(np.unpackbits(bits, count=len(matrix))))
        yield best.batch()

    return run


class VectorIndex(SegmentIndex):
    """Nearest neighbours in the embeddings of the store; vectors of another width than `width` are not indexed."""

    def __init__(self, catalog: Catalog, width: int, table: str = "embeddings", column: str = "embedding", list_rows: int = LIST_ROWS, name: str = "vector"):
        super().__init__(catalog, table, f"{name}-{width}")
        self.width, self.column, self.list_rows = width, column, list_rows

    def build(self, segment: Segment, rows: DataFrame) -> None:
        rows = rows.select(F.col(self.key).alias("id"), "_pos", F.col(self.column).cast("array<float>").alias("embedding"))
        rows = rows.filter((F.size("embedding") == self.width) & ~F.exists("embedding", lambda x: x.isNull()))
        n = rows.count()
        lists = max(1, min(MOST_LISTS, n // self.list_rows))
        most = min(max(4 * HELD_OUT, lists * SAMPLE_A_LIST), max(1, SAMPLE_BYTES // (8 * self.width)))
        share = F.xxhash64("id") % 1_000_003
        part = rows.filter(F.abs(share) < int(1_000_003 * min(1.0, 1.2 * most / n))) if n > most else rows
        found = part.select("embedding").limit(most).toArrow().column("embedding")  # a bounded sample, spread by a hash
        sample = unit(found.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.width)) if len(found) else np.zeros((0, self.width))
        lists = max(1, min(lists, len(sample)))
        centroids = fit_lists(sample, lists) if len(sample) else np.zeros((1, self.width))
        probes = probes_needed(sample, centroids) if lists > 1 else 1
        shared = self.spark.sparkContext.broadcast(centroids)
        listed = rows.mapInArrow(_assign(shared), LISTS)
        # salted by id, so that a large list is in several files; sorted, so that a scan for some lists skips the others
        dealt = listed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id")
        self.put("lists", segment, dealt, **{"parquet.page.row.count.limit": "1000"})
        sizes = {r.list: r.n for r in self.read("lists", [segment], LISTS).groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
        table = [(i, sizes.get(i, 0), probes, [float(v) for v in c]) for i, c in enumerate(centroids)]
        self.put("centroids", segment, self.spark.createDataFrame(table, CENTROIDS).coalesce(1))

    def probed(self, matrix: np.ndarray, k: int, probes: int | None = None) -> tuple[dict[tuple[str, int], np.ndarray], int, int]:
        """Packed bits of the rows of the matrix (unit vectors) that ask each (segment, list); the number of such pairs, and of all there could be."""
        manifest, segments = self.current()
        by_segment: dict[str, list] = {}
        for r in self.read("centroids", segments, CENTROIDS).collect() if segments else []:  # MOST_LISTS rows a segment at most
            by_segment.setdefault(r.w, []).append((r.list, r.n, r.probes, np.array(r.centroid, np.float64)))
        asking: dict[tuple[str, int], np.ndarray] = {}
        asked = every = 0
        for w, rows in sorted(by_segment.items()):
            rows.sort(key=lambda r: r[0])
            sizes, centroids = np.array([n for _, n, _, _ in rows]), np.array([c for *_, c in rows])
            hidden = manifest.deleted[w].n if w in manifest.deleted else 0
            bits = []
            step = max(8, vector_search.CELLS // len(rows) // 8 * 8)
            for i in range(0, len(matrix), step):
                order = np.argsort(-(matrix[i : i + step] @ centroids.T), axis=1, kind="stable")
                # lists until the probes are made and k live rows are certain
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                wanted = (np.arange(len(rows))[None, :] < (probes or rows[0][2])) | (before - hidden < k)
                wanted &= sizes[order] > 0
                asked += int(wanted.sum())
                of = np.zeros_like(wanted)
                np.put_along_axis(of, order, wanted, axis=1)
                bits.append(np.packbits(of, axis=0))
            every += len(matrix) * int((sizes > 0).sum())
            for place, packed in enumerate(np.concatenate(bits).T if bits else []):
                if packed.any():
                    asking[w, rows[place][0]] = np.ascontiguousarray(packed)
        return asking, asked, every

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank of about the k nearest live rows (see RECALL); never fewer than there are.

        queries: query_id (long), embedding. `probes`: lists a segment, instead of those found at the build.
        """
        parts, _ = vector_search.batches(queries, k, self.width)
        found = [x for part in parts if (x := self._found(part, k, probes)) is not None]
        if not found:
            found = [self.spark.createDataFrame([], "query_id long, id long, score double")]
        return bm25.top_k(reduce(DataFrame.unionByName, found), k)

    def _found(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame | None:
        """query_id, id, score: the best of each task, for queries that travel to every task."""
        query_ids, matrix = vector_search.checked(queries, k, self.width)
        manifest, segments = self.current()
        asking = self.probed(matrix, k, probes)[0]
        if not asking:
            return None
        wanted = [(s, sorted(i for w, i in asking if w == s.name)) for s in segments]
        chosen = F.lit(False)
        for s, lists in wanted:
            chosen = chosen | (F.col("w") == s.name) & F.col("list").isin(lists)
        rows = self.read("lists", [s for s, lists in wanted if lists], LISTS).filter(chosen)
        live = self.catalog.visible(self.table, manifest, rows).select("w", "list", "id", "embedding")
        shared = self.spark.sparkContext.broadcast((query_ids, matrix, asking))
        return live.mapInArrow(_search(shared, k), "query_id long, id long, score double")

    def vectors(self) -> DataFrame:
        """id, embedding of the live rows, for an exact search."""
        return self.catalog.scan(self.table).select(F.col(self.key).alias("id"), F.col(self.column).alias("embedding"))
