"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters.

Counts: the 4-grams of trusted texts are counted in every task and summed by gram; the
lower orders, discounts and probabilities are groupings and joins of these tables by gram.
The model is a table with a row for each gram that trusted texts hold: its probability,
and the weight that it leaves to lower orders as a context. Scoring: documents are taken
in slices. A slice's distinct grams are joined with the model by gram, so the join is
sharded by gram and a gram costs a row a slice, however common it is; what is found goes
back to the slice, where its documents' probabilities are added up. No table of all grams
is in any one place. Every character is a symbol of its own, but upper-case letters, which are
one, and digits. Thresholds: the quantile of perplexity among all trusted documents of the
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import discard, settings, shuffled, stage, text_of, tidy, tidy_cogroup, unused
from .words import mixed, slices

ORDER = 4
#: Symbols: around a text, any upper-case letter, any digit; others are their code point + FIRST.
EDGE, UPPER, DIGIT, FIRST = 0, 1, 2, 3
N_SYMBOLS = 0x110000 + FIRST
QUANTILE, MARGIN = 0.99, 1.1
#: Characters worked on at a time, bytes of text in a slice, codes up to which a table is quicker than sorting, steps of log10 perplexity.
CHARS, SLICE, TABLE, STEPS = 1_000_000, 16_000_000, 1 << 25, 10_000
#: Rows that Spark hands over together: they lie in memory on both sides.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}
#: Bits of a Bloom filter of ids, for each id and at most (8 MB).
ID_BITS, MAX_BITS = 16, 1 << 26


@cache
def _symbols_of() -> np.ndarray:
    """Symbol of each code point."""
    table = np.arange(FIRST, N_SYMBOLS, dtype=np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isupper():
            table[code] = UPPER
        elif char.isdigit():
            table[code] = DIGIT
    return table


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with ORDER - 1 edges before and one behind; the texts' sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(int((sizes + ORDER).sum()), EDGE, np.int32)
    begin = np.cumsum(sizes + ORDER) - (sizes + ORDER) + ORDER - 1
    out[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))] = _symbols_of()[codes]
    return out, sizes


def pieces(texts: list[str], chars: int = CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """About `chars` symbols at a time: symbols, where the 4-grams end (at a character or a text's end), and the text of each."""
    at = 0
    while at < len(texts):
        to, room = at, chars
        while to < len(texts) and room > 0:
            room -= len(texts[to]) + 1
            to += 1
        symbols, sizes = _laid_out(texts[at:to])
        text = np.repeat(np.arange(at, to), sizes + 1)
        ends = np.arange(len(text)) + (ORDER - 1) * (text - at + 1)
        lead = ORDER - 1
        for a in range(0, len(text), chars):  # more than once for a long text only
            mine = ends[a : a + chars]
            yield symbols[mine[0] - lead : mine[-1] + 1], mine - (mine[0] - lead), text[a : a + chars]
        at = to


def _renumbered(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codes, which are below limit, and the distinct codes in order."""
    if limit > TABLE:
        distinct, number = np.unique(codes, return_inverse=True)
        return number, distinct
    number = np.zeros(limit, np.int32)
    number[codes] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return number[codes], distinct


def distinct_grams(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of the 4-gram at each end, and the four symbols of each distinct one."""
    number, alphabet = _renumbered(symbols, N_SYMBOLS)
    n = len(alphabet)
    pair, pairs = _renumbered(number[:-1].astype(np.int64) * n + number[1:], n * n)
    m = len(pairs)
    gram, grams = _renumbered(pair[ends - 3].astype(np.int64) * m + pair[ends - 1], m * m)
    first, second = pairs[grams // m], pairs[grams % m]
    return gram, [alphabet[x] for x in (first // n, first % n, second // n, second % n)]


def gram_key(symbols: list[np.ndarray]) -> np.ndarray:
    """64-bit keys (signed) of grams of one to four symbols."""
    key = np.full(len(symbols[0]), len(symbols), np.uint64)
    for s in symbols:
        key = mixed(key + s.astype(np.uint64), len(symbols))
    return key.view(np.int64)


#: Of a 4-gram a b c d: the grams that end it, and the contexts of those.
PARTS = {"k4": (0, 4), "k3": (1, 4), "k2": (2, 4), "k1": (3, 4), "h3": (0, 3), "h2": (1, 3), "h1": (2, 3)}


def _part_keys(symbols: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {name: gram_key(symbols[a:b]) for name, (a, b) in PARTS.items()}


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text: the keys of distinct 4-grams and their counts, a row for each in each piece."""
    for whole in batches:
        for batch in slices(whole, 0, CHARS):
            for symbols, ends, _ in pieces(batch.column(0).to_pylist()):
                gram, found = distinct_grams(symbols, ends)
                columns = [*_part_keys(found).values(), np.bincount(gram, minlength=len(found[0]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*PARTS, "n"])


def discounts(of: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from how many grams have counts 1 to 4."""
    share = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * share * of[i] / of[i - 1] if of[i - 1] else i / 2
        out.append(min(max(d, 0.05), i - 0.05))
    return tuple(out)


@dataclass
class Model:
    """table: key, p (of a gram), left (the weight of lower orders behind a context); floor: the probability of a symbol never seen."""

    table: DataFrame
    floor: float


def kneser_ney(counts: DataFrame) -> Model:
    """The interpolated model, with three discounts an order. counts: the keys of PARTS and n, a row for each 4-gram.

    The count of a lower-order gram is the number of distinct symbols before it. The
    lowest order is interpolated with 1 / (distinct symbols + 1).
    """
    grams = {4: counts.withColumnRenamed("n", "c")}
    for n in (3, 2, 1):
        keys = [f"k{i}" for i in range(n, 0, -1)] + [f"h{i}" for i in range(n - 1, 0, -1)]
        grams[n] = grams[n + 1].groupBy(*keys).agg(F.count("*").alias("c"))
    lower, floor, parts = None, 1.0, []
    for n in (1, 2, 3, 4):
        stats = grams[n].agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)], F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        d = [F.lit(x) for x in discounts(tuple(stats[:4]))]
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = grams[n].select(*[k for k in PARTS if k in grams[n].columns], "c", taken.alias("d"))
        if n == 1:
            total, size = stats[4], stats[5]
            left = rows.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0] / total if total else 1.0
            floor = left / (size + 1)
            lower = rows.select("k1", ((F.col("c") - F.col("d")) / F.lit(float(total or 1)) + F.lit(floor)).alias("p"))
        else:
            context = f"h{n - 1}"
            of = rows.groupBy(context).agg(F.sum("c").alias("total"), F.sum("d").alias("d_sum"))
            of = stage(of.select(context, "total", (F.col("d_sum") / F.col("total")).alias("left")), "kn-contexts")
            below = lower.withColumnRenamed("p", "p_lower")
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("left") * F.col("p_lower")
            lower = rows.join(of, context).join(below, f"k{n - 1}").select(f"k{n}", p.alias("p"))
            parts.append(of.select(F.col(context).alias("key"), F.lit(None).cast("double").alias("p"), "left"))
        lower = stage(lower, "kn-grams")
        parts.append(lower.select(F.col(f"k{n}").alias("key"), "p", F.lit(None).cast("double").alias("left")))
    table = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("p").alias("p"), F.max("left").alias("left"))
    return Model(stage(table, "kn-model"), floor)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled of good quality and not toxic; a null label trusts nothing."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")


def _bloom(n: int) -> dict[str, str]:
    """Spark's settings to leave out by a Bloom filter of n ids what a join would shuffle in vain."""
    bits = min(max(ID_BITS * n, 1 << 13), MAX_BITS)
    filters = "spark.sql.optimizer.runtime.bloomFilter"
    sizes = {"expectedNumItems": n or 1, "maxNumItems": n or 1, "numBits": bits, "maxNumBits": bits}
    always = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t"}
    return {f"{filters}.{k}": str(v) for k, v in {**always, **sizes}.items()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> Model:
    """The model of all trusted texts; with fit_rows only of so many, those with the smallest hash of their id.

    Where the ids are too many to broadcast, the join shuffles the texts that pass a Bloom
    filter of them, not all.
    """
    trusted = trusted_ids(labels)
    n = trusted.count()
    if fit_rows is not None:
        trusted = F.broadcast(trusted.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = docs.select("doc_id", text_of().alias("text")).join(trusted, "doc_id", "left_semi").select("text")
    schema = ", ".join(f"{k} long" for k in [*PARTS, "n"])
    with settings(docs.sparkSession, BATCH_ROWS | _bloom(n)):
        counts = stage(texts.mapInArrow(tidy(_count_grams), schema).groupBy(*PARTS).agg(F.sum("n").alias("n")), "kn-counts")
    model = kneser_ney(counts)
    discard(counts)
    return model


def _pack(rows: pa.RecordBatch, keys: np.ndarray) -> bytes:
    """Rows and the keys of their grams, compressed, behind the length of the keys."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    plain = sink.getvalue()
    body = pa.Codec("zstd", compression_level=3).compress(plain, asbytes=True)
    head = np.array([len(keys), plain.size], "<i8").tobytes()
    return head + keys.astype("<i8").tobytes() + body


def _unpack_keys(payload: memoryview) -> np.ndarray:
    return np.frombuffer(payload, "<i8", int(np.frombuffer(payload, "<i8", 1)[0]), 16)


def _unpack_rows(payload: memoryview) -> pa.Table:
    n, size = np.frombuffer(payload, "<i8", 2).tolist()
    body = pa.Codec("zstd").decompress(payload[16 + 8 * n :], decompressed_size=size)
    return pa.ipc.open_stream(body).read_all()


def _texts(rows: pa.RecordBatch | pa.Table) -> list[str]:
    return [t or "" for t in rows.column("text").to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice (a number), payload: a slice's rows and the keys of all their grams and contexts."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        at = whole.schema.get_field_index("text")
        filled = whole.set_column(at, "text", whole.column(at).fill_null(""))
        for part, sized in _in_step(whole, filled, at):
            keys = np.zeros(0, np.int64)
            for symbols, ends, _ in pieces(_texts(sized)):
                keys = np.unique(np.concatenate([keys, *_part_keys(distinct_grams(symbols, ends)[1]).values()]))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(part, keys)], pa.binary())], names=["slice", "payload"])
            number += 1


def _in_step(whole: pa.RecordBatch, filled: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    done = 0
    for part in slices(filled, at, SLICE):
        yield whole.slice(done, part.num_rows), part
        done += part.num_rows


def _slice_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(batch.column(0), batch.column(1)):
            keys = _unpack_keys(memoryview(payload.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number.as_py())), pa.array(keys)], names=["slice", "key"])


class Found:
    """What a slice needs of the model: probabilities and weights by key."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, left: np.ndarray, floor: float):
        """p and left are NaN where a key has none."""
        order = np.argsort(keys)
        self.keys, self.p, self.left, self.floor = keys[order], p[order], left[order], floor

    def _of(self, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, values[at], np.nan)

    def log_p(self, symbols: list[np.ndarray]) -> np.ndarray:
        """log10 P(d | a b c) of 4-grams: the longest gram known, behind the weights left by longer contexts."""
        keys = _part_keys(symbols)
        own = self._of(self.p, keys["k1"])
        p = np.where(np.isnan(own), self.floor, own)
        for n in (2, 3, 4):
            own, left = self._of(self.p, keys[f"k{n}"]), self._of(self.left, keys[f"h{n - 1}"])
            p = np.where(np.isnan(own), np.where(np.isnan(left), 1.0, left) * p, own)
        return np.log10(p)

    def score(self, texts: list[str], chars: int = CHARS) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        total = np.zeros(len(texts))
        for symbols, ends, text in pieces(texts, chars):
            gram, found = distinct_grams(symbols, ends)
            first = int(text[0])
            sums = np.bincount(text - first, weights=self.log_p(found)[gram])
            total[first : first + len(sums)] += sums
        return total


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """docs and perplexity: of a character, the end counted; null where there is no text."""
    cut = docs.mapInArrow(tidy(_sliced), "slice long, payload binary").repartition("slice")  # read twice, made once
    known = cut.mapInArrow(tidy(_slice_keys), "slice long, key long").join(shuffled(model.table), "key").select("slice", "key", "p", "left")
    schema, floor = StructType([*docs.schema.fields, StructField("perplexity", DoubleType())]), model.floor

    def scored(own: pa.Table, found: pa.Table) -> pa.Table:
        numbers = [found.column(c).to_numpy() for c in ("key", "p", "left")]
        rows = _unpack_rows(memoryview(own.column("payload").combine_chunks()[0].as_buffer()))
        texts = _texts(rows)
        sizes = np.array([len(t) for t in texts], np.int64)
        logs = Found(*numbers, floor).score(texts)
        return rows.append_column("perplexity", pa.array(10.0 ** (-logs / (sizes + 1)), mask=sizes == 0))

    return cut.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(tidy_cogroup(scored), schema)


def _staged(scored: DataFrame) -> DataFrame:
    with settings(scored.sparkSession, BATCH_ROWS):
        return stage(scored, "perplexities")


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """lang, threshold: margin times the quantile of perplexity among all trusted documents of the language.

    The quantile is that of perplexities counted in steps of a ten-thousandth of their
    log10, the next step up, so that reruns agree; counts are added up by language and step
    first, so that a language has a bounded number of rows however many documents it has.
    A language without trusted documents has no row.
    """
    known = scored.filter("perplexity IS NOT NULL").select("doc_id", "lang", "perplexity").join(trusted_ids(labels), "doc_id", "left_semi")
    counted = known.groupBy("lang", F.floor(F.log10("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    step = F.ceil(F.round(F.percentile("step", quantile, F.col("n")), 6))
    reached = counted.groupBy("lang").agg(step.alias("step"))
    return reached.select("lang", (F.pow(F.lit(10.0), (F.col("step") + 1) / float(STEPS)) * margin).alias("threshold"))


def with_thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """scored (doc_id, lang, perplexity and more) and threshold, keep; see judge."""
    limits = stage(thresholds(scored, labels, quantile, margin), "thresholds")
    largest = limits.agg(F.max("threshold")).first()[0]
    of_lang, limit = (unused(name, scored.columns) for name in ("limits_lang", "limit"))
    named = limits.select(F.col("lang").alias(of_lang), F.col("threshold").alias(limit))
    joined = scored.join(named, F.col("lang").eqNullSafe(F.col(of_lang)), "left")
    threshold = F.coalesce(limit, F.lit(largest).cast("double"), F.lit(float("inf")))
    keep = F.coalesce(F.col("perplexity") <= threshold, F.lit(False))
    return joined.select(*scored.columns, threshold.alias("threshold"), keep.alias("keep"))


def judge(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, fit_rows: int | None = None
) -> DataFrame:
    """docs and perplexity, threshold, keep (boolean).

    docs: doc_id, text, lang and any other columns but those three; labels: doc_id,
    quality, toxic. keep is true where the perplexity is at most the language's
    threshold; languages without trusted documents (null too) have the largest of all
    thresholds. Null and empty texts have no perplexity and are not kept. Without any
    trusted document all others are kept. Repeated rows are judged alike. An empty table
    gives an empty one.
    """
    docs = docs.drop("perplexity", "threshold", "keep")
    return with_thresholds(_staged(perplexity(docs, fit(docs, labels, fit_rows))), labels, quantile, margin)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the text isn't staged with the scores: the query gives digests only
    scored = _staged(perplexity(docs, fit(docs, labels)).drop("text"))
    return with_thresholds(scored, labels)
