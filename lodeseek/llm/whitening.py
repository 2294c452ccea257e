"""Whitening of embeddings: covariance by generated column aggregates, decomposed by LAPACK.

Two aggregations: sums and ranges of each dimension, then, in one aggregation whose
expressions are generated, the sums of centred products of each pair of dimensions of the
upper triangle. Vectors wider than DIRECT are cut into tiles, whose pairs are the groups of
that aggregation, as a few hundred expressions run many times faster than some thousands.
Sums are of whole numbers, exact wherever they fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions whose pairs are summed without tiles; side of a tile beyond. 64 dimensions of 51,282 vectors took
#: 48 s by 2,080 expressions, 9 s by tiles.
DIRECT, TILE = 16, 16
#: Entries are left out from here on: beyond, a double doesn't hold each whole number.
LARGEST = 2**52
#: Components with less than this part of the largest eigenvalue have no direction of their own.
RANK = 1e-12
LONG = 2**63


@dataclass
class Whitening:
    """n: vectors fitted; sums: of each dimension, exact; components: unit rows by falling eigenvalue; trace: of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]


def quantized(vectors: DataFrame, scale: int = 1024, offset: int = 100_000, column: str = "embedding") -> DataFrame:
    """vectors with x: floor(scale * entry) + offset for each entry, whole numbers.

    Rows are left out whose vector is null, empty, or holds an entry that is null, not
    finite, or at scale or with the offset beyond LARGEST.
    """
    wide = F.transform(column, lambda c: c.cast("double") * scale)
    able = F.forall(wide, lambda c: c.isNotNull() & (F.abs(c) < LARGEST - abs(offset))) & (F.size(column) > 0)
    return vectors.filter(able).withColumn("x", F.transform(wide, lambda c: F.floor(c) + offset))


def of_one_width(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the commonest width, for ties the larger one, and that width; 0 for none."""
    found = vectors.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = found.width if found else 0
    return vectors.filter(F.size("x") == width), width


def pair_sums(vectors: DataFrame, centre: list[int], kind: str, tile: int = TILE, direct: int = DIRECT) -> Iterator[tuple[int, int, int | float]]:
    """i, j (i <= j) and the sum of (x_i - centre_i) * (x_j - centre_j), in one aggregation of generated expressions."""
    width = len(centre)
    centred = F.zip_with("x", F.array(*map(F.lit, centre)), lambda x, c: (x - c).cast(kind))
    if width <= direct:
        columns = vectors.select(*[(F.get("x", F.lit(i)) - centre[i]).cast(kind).alias(f"d{i}") for i in range(width)])
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        sums = columns.agg(*[F.expr(f"sum(d{i} * d{j})").alias(f"s{i}_{j}") for i, j in pairs]).first()
        yield from ((i, j, s) for (i, j), s in zip(pairs, sums))
        return
    blocks = range(-(-width // tile))
    numbers = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in blocks for q in blocks if p <= q])
    sides = vectors.select(centred.alias("d"), F.explode(numbers).alias("t")).select(
        "t.p", "t.q", *[F.slice("d", F.col(f"t.{side}") * tile + 1, F.lit(tile)).alias(name) for side, name in (("p", "a"), ("q", "b"))]
    )
    sums = sides.groupBy("p", "q").agg(*[F.expr(f"sum(get(a, {i}) * get(b, {j}))").alias(f"s{i}_{j}") for i in range(tile) for j in range(tile)])
    for row in sums.toLocalIterator():  # a row for each pair of tiles: the covariance, no more
        for i in range(tile):
            for j in range(tile):
                at = row.p * tile + i, row.q * tile + j
                if at[0] <= at[1] < width:
                    yield *at, row[f"s{i}_{j}"]


def fit(vectors: DataFrame, width: int, tile: int = TILE, direct: int = DIRECT) -> Whitening | None:
    """The whitening of vectors with x, an array of `width` longs; None for no vectors."""
    if not width:
        return None
    each = vectors.agg(
        F.count("*").alias("n"),
        *[f(F.get("x", F.lit(i)).cast(kind)).alias(f"{name}{i}") for i in range(width) for name, f, kind in (("s", F.sum, "decimal(28,0)"), ("a", F.min, "long"), ("b", F.max, "long"))],
    ).first()
    if not each.n:
        return None
    n, sums = each.n, [int(each[f"s{i}"]) for i in range(width)]
    centre = [s // n for s in sums]
    reach = max(max(each[f"b{i}"] - c, c - each[f"a{i}"]) for i, c in enumerate(centre))
    kind = "long" if n * (reach + 1) ** 2 < LONG else "double"
    covariance = np.zeros((width, width))
    offset = [s - n * c for s, c in zip(sums, centre)]  # what the centred entries sum to
    for i, j, s in pair_sums(vectors, centre, kind, tile, direct):
        # whole numbers as long as they are exact, one division at the end
        covariance[i, j] = covariance[j, i] = (n * s - offset[i] * offset[j]) / (n * n) if kind == "long" else s / n - offset[i] / n * (offset[j] / n)
    values, directions = np.linalg.eigh(covariance)
    values, components = values[::-1], directions.T[::-1]
    largest = np.take_along_axis(components, np.abs(components).argmax(axis=1)[:, None], 1)
    return Whitening(n, sums, components * np.where(largest < 0, -1.0, 1.0), values, float(np.trace(covariance)))


def _dot(values: Column | str, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)


def whiten(vectors: DataFrame, model: Whitening, most: int = 8) -> DataFrame:
    """vectors with `whitened`, up to `most` components; null ones where there is no variance."""
    k = min(most, len(model.sums))
    floor = RANK * max(float(model.eigenvalues[0]), 0.0)
    centred = F.zip_with("x", F.array(*map(F.lit, model.mean)), lambda x, m: x - m)
    parts = [
        _dot("_centred", [float(w) for w in c]) / F.lit(float(e) ** 0.5) if e > floor else F.lit(None).cast("double")
        for c, e in zip(model.components[:k], model.eigenvalues[:k])
    ]
    return vectors.withColumn("_centred", centred).withColumn("whitened", F.array(*parts)).drop("_centred")


def deviation(model: Whitening) -> Column:
    """The sum over dimensions of (n * x - sum)^2, exact; null where a long can't hold it."""
    n = model.n
    rounded = F.zip_with("x", F.array(*map(F.lit, model.mean)), lambda x, m: (x - m) * float(n))
    about = F.aggregate(rounded, F.lit(0.0), lambda s, d: s + d * d)
    whole = [s // n for s in model.sums]
    shifted = F.zip_with(
        F.zip_with("x", F.array(*map(F.lit, whole)), lambda x, c: x - c), F.array(*[F.lit(s - n * c) for s, c in zip(model.sums, whole)]), lambda d, rest: d * n - rest
    )
    exact = F.aggregate(shifted, F.lit(0).cast("long"), lambda s, d: s + d * d)
    return F.when(about < 0.999 * LONG, exact)


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of `whitened` (its first k components, null ones left out) less the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get("whitened", F.lit(i))
    found = whitened.agg(*[F.covar_pop(at(i), at(j)) for i, j in pairs]).first() if pairs else []
    errors = [abs(c - (i == j)) for (i, j), c in zip(pairs, found) if c is not None]
    return max(errors) if errors else None


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(vectors: DataFrame, most: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """A row for each vector and component, as op12's contract names them. vectors: vec_id, embedding; other columns are ignored.

    Vectors are fitted and whitened as `quantized` leaves them, those of the commonest
    width only; repeated rows count each, a null vec_id stays null. Components without
    variance have a null `whitened`, without any variance `explained` is null too.
    Narrow vectors have as many components as dimensions. An empty table gives no rows.
    """
    x, width = of_one_width(quantized(vectors.select("vec_id", "embedding"), scale, offset).select("vec_id", "x"))
    model = fit(x, width)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k = min(most, width)
    whitened = whiten(x, model, k)
    error = identity_error(whitened, k)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues[:k]]
    each = whitened.select("vec_id", deviation(model).alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
