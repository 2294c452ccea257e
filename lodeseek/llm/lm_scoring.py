"""Language-model scoring of whole documents.

Words of all documents are counted exactly. The commonest HEAD words, a bounded number,
travel to every task; the others, of which none makes up more than 1/HEAD of the text,
are joined with their counts in a shuffle. The gated recurrent model predicts units: the
commonest words, the end of a text, and buckets of rarer words by their last letters; a
word of a bucket then has its smoothed share of the bucket. Training reads every document
to learn from once, in rounds and shards by hash, whose number follows from the tokens and
not from partitions: in a round each shard trains from the same state (weights and Adam's
moments), and the states are averaged in a tree. So a score depends on the table
alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import discard, keep_temporaries, one_blas_thread, stage, text_of, tidy
from .words import slices, split_distinct

HEAD, CLASSES, BUCKETS, ROUNDS = 1 << 18, 64, 512, 6
#: Tokens of a shard, on average; parts of a state, and states added up in one task.
SHARD_TOKENS, STATE_A_ROW, FAN_IN = 1_000_000, 1 << 16, 64
#: Documents are read and scored together up to so many bytes.
SLICE = 12_000_000
#: The end of a text; no word is empty.
END = b""


def is_held_out() -> Column:
    """crc32(doc_id as text) mod 7 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def split_with_end(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """split_distinct of the A-Z lower-cased texts, the words binary; behind them stands the end, which no token is yet."""
    number, words, sizes = split_distinct(pc.ascii_lower(texts))
    return number, pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())]), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts, those to learn from and all, as partial counts."""
    for whole in batches:
        for batch in slices(whole, 0, SLICE):
            number, words, sizes = split_with_end(batch.column(0))
            learnt = ~batch.column(1).to_numpy(zero_copy_only=False)
            n = np.bincount(number[np.repeat(learnt, sizes)], minlength=len(words))
            n_all = np.bincount(number, minlength=len(words))
            n[-1], n_all[-1] = learnt.sum(), len(sizes)
            yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(n_all)], names=["word", "n", "n_all"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, A-Z lower-cased; empty: the end), n in documents to learn from, n_all in all."""
    rows = docs.select(text_of().alias("text"), is_held_out().alias("held_out"))
    partial = rows.mapInArrow(tidy(_count), "word binary, n long, n_all long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def buckets_of(words: pa.Array) -> np.ndarray:
    """The same of each word."""
    endings = pc.binary_slice(words, -3).dictionary_encode()
    return np.array([bucket(e) for e in endings.dictionary.to_pylist()], np.int64)[endings.indices.to_numpy()]


class Lexicon:
    """The head words' counts and units, and what the buckets hold."""

    def __init__(self, words: list[bytes], n: np.ndarray, bucket_n: np.ndarray, bucket_words: np.ndarray, classes: int = CLASSES):
        """words: END and the head, n: their counts to learn from; bucket_n, bucket_words: of the words that aren't in the head."""
        self.words, end = pa.array(words, pa.binary()), words.index(END)
        self.log_n = np.log10(n + 1.0)
        self.known = n > 0
        named = np.argsort(-n, kind="stable")
        named = named[n[named] > 0][: classes * gru.CLASS - BUCKETS - 1]
        if end not in named:
            named = np.append(named, end)
        rare = np.setdiff1d(np.arange(len(words)), named)
        of = buckets_of(self.words.take(pa.array(rare)))
        self.bucket_n = bucket_n + np.bincount(of, n[rare], BUCKETS)
        in_bucket = bucket_words + np.bincount(of, n[rare] > 0, BUCKETS)
        self.bucket_log = np.log10(self.bucket_n + in_bucket + 1.0)
        mass = np.zeros(classes * gru.CLASS)
        mass[: len(named)], mass[len(named) : len(named) + BUCKETS] = n[named], self.bucket_n
        order = np.argsort(-mass, kind="stable")
        rank = np.empty(len(mass), np.int64)
        rank[order] = np.arange(len(mass))
        self.mass = mass[order]
        self.bucket_unit = rank[len(named) : len(named) + BUCKETS]
        self.unit = np.empty(len(words), np.int64)
        self.unit[named] = rank[: len(named)]
        self.unit[rare] = self.bucket_unit[of]
        self.bucket_of = np.full(len(words), -1)
        self.bucket_of[rare] = of
        self.bos = int(self.unit[end])

    @cached_property
    def index(self) -> dict[bytes, int]:
        """The place of each head word. Tasks look up whole columns of words instead, which takes no Python object for a word."""
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def read(self, texts: pa.Array) -> "Tokens":
        """All tokens of the texts, the ends among them."""
        number, words, sizes = split_with_end(texts)
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        missing = place < 0
        buckets = self.bucket_of[place]
        buckets[missing] = buckets_of(words.filter(pa.array(missing)))
        units = self.unit[place]
        units[missing] = self.bucket_unit[buckets[missing]]
        number = np.insert(number, np.cumsum(sizes), len(words) - 1)
        # of each distinct word: its own log count if it is in the head, and what its bucket takes off
        log_n = np.where(missing, 0, self.log_n[place])
        within = np.where(buckets >= 0, log_n - self.bucket_log[buckets], 0)
        return Tokens(number, sizes + 1, words, missing, units, ~missing & self.known[place], log_n, within)


@dataclass
class Tokens:
    """number, sizes: which distinct word each token is, tokens of each text; the rest is of the distinct words."""

    number: np.ndarray
    sizes: np.ndarray
    words: pa.Array
    missing: np.ndarray
    units: np.ndarray
    known: np.ndarray
    log_n: np.ndarray
    within: np.ndarray


def lexicon(counts: DataFrame, head: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon of the `head` commonest words and the end, and the counts of all others."""
    top = counts.filter(F.col("word") != END).orderBy(F.desc("n_all"), "word").limit(head).toArrow()  # bounded by head
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [END, *top.column("word").to_pylist()]
    n = np.concatenate([[ends], top.column("n").to_numpy()]).astype(np.float64)
    least = (top.column("n_all")[-1].as_py(), top.column("word")[-1].as_py()) if len(words) > head else (0, END)
    behind = (F.col("n_all") < least[0]) | (F.col("n_all") == least[0]) & (F.col("word") > F.lit(least[1]))
    tail = counts.filter(behind & (F.col("word") != END))
    ascii_tail = F.crc32(F.substring("word", -3, 3)) % BUCKETS
    tail_buckets = tail.filter("n > 0").groupBy(ascii_tail.alias("b")).agg(F.sum("n"), F.count("*")).collect()  # BUCKETS rows
    bucket_n, bucket_words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n_b, v_b in tail_buckets:
        bucket_n[b], bucket_words[b] = n_b, v_b
    return Lexicon(words, n, bucket_n, bucket_words), tail


READ = "row_id long, doc_id {}, held_out boolean, copy_key long, n_tokens long, head_known long, head_log double, within double, tail array<binary>, units binary"


def _read(shared_lex):
    """From doc_id, held_out, copy_key, text: the columns of READ. Texts are split once here, for training and for scoring."""
    names = [c.split()[0] for c in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part, n_rows = shared_lex.value, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 3, SLICE):
                tokens = lex.read(batch.column(3))
                number, sizes = tokens.number, tokens.sizes
                # the share of a bucket that the words of the head in it take is settled here, that of the others by the join
                begins = np.cumsum(sizes) - sizes  # each text has its end, so none is empty
                known, head_log, within = (np.add.reduceat(v.take(number), begins) for v in (tokens.known.astype(np.int64), tokens.log_n, tokens.within))
                behind = tokens.missing.take(number)
                offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(behind, begins, dtype=np.int64))]).astype(np.int32)
                tails = tokens.words.take(pa.array(number[behind]))
                flat, ends = tokens.units.astype("<u2").take(number), np.concatenate([[0], np.cumsum(sizes)]) * 2
                units = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                ids = np.arange(n_rows, n_rows + len(sizes), dtype=np.int64) + (part << 33)
                n_rows += len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), *batch.columns[:3], pa.array(sizes), pa.array(known), pa.array(head_log), pa.array(within), pa.ListArray.from_arrays(pa.array(offsets), tails), units],
                    names=names,
                )

    return tidy(run)


def read_documents(docs: DataFrame, shared_lex) -> DataFrame:
    """READ of each row: what scoring takes from its words, and its units (little-endian, two bytes each)."""
    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.xxhash64("doc_id", "text").alias("copy_key"), text_of().alias("text"))
    return rows.mapInArrow(_read(shared_lex), READ.format(docs.schema["doc_id"].dataType.simpleString()))


def training_units(read: DataFrame, shards: int, rounds: int) -> DataFrame:
    """round, shard, place, units of each document to learn from.

    Round and shard are by hash of id and text; rows that repeat both go to one shard after
    another, so that a shard's size is bounded however often a row is repeated.
    """
    each = read.filter(~F.col("held_out")).groupBy("copy_key").agg(F.count("*").alias("n"), F.min("units").alias("units"))
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = F.pmod(F.pmod(F.col("copy_key"), F.lit(rounds * shards)) + F.col("copy"), F.lit(rounds * shards))
    return copies.select((place % rounds).cast("int").alias("round"), F.floor(place / rounds).alias("shard"), F.col("copy_key").alias("place"), "units")


def _fit(shared, bos: int):
    """Train on one shard from the shared state: its state in parts, and the units read."""

    def run(shard: pa.Table) -> pa.Table:
        one_blas_thread()
        keep_temporaries()
        shard = shard.sort_by([("place", "ascending")])
        documents = [np.frombuffer(u.as_buffer(), "<u2") for u in shard.column("units").combine_chunks()]
        state, read = gru.train(shared.value, CLASSES, documents, bos)
        rows = [state[i : i + STATE_A_ROW].tobytes() for i in range(0, len(state), STATE_A_ROW)]
        n, slot = len(rows), shard.column("shard")[0].as_py()
        return pa.table({"part": pa.array(range(n), pa.int32()), "slot": pa.array([slot] * n, pa.int64()), "n_read": pa.array([read] * n, pa.int64()), "state": pa.array(rows, pa.binary())})

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """The mean of up to FAN_IN states' parts by units read, in the order of their slots."""
    rows = rows.sort_by([("slot", "ascending")])
    read = rows.column("n_read").to_numpy()
    mean = sum(np.frombuffer(b, np.float32) * (n / read.sum()) for b, n in zip(rows.column("state").to_pylist(), read.astype(np.float64)))
    slot = rows.column("slot")[0].as_py() // FAN_IN
    return pa.table({"part": rows.column("part").slice(0, 1), "slot": pa.array([slot], pa.int64()), "n_read": pa.array([int(read.sum())]), "state": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(units: DataFrame, lex: Lexicon, shards: int, rounds: int) -> np.ndarray:
    """The weights. units: round (0 to rounds - 1), shard, place, units."""
    spark = units.sparkSession
    state, schema = gru.fresh(gru.initial(lex.mass)), "part int, slot long, n_read long, state binary"
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(state)  # one model
        states = units.filter(F.col("round") == r).groupBy("shard").applyInArrow(_fit(shared, lex.bos), schema)
        left = shards
        while left > 1:
            states = states.groupBy("part", F.expr(f"slot div {FAN_IN}")).applyInArrow(_averaged, schema)
            left = -(-left // FAN_IN)
        whole = states.toArrow().sort_by("part")
        if whole.num_rows:
            state = np.concatenate([np.frombuffer(b, np.float32) for b in whole.column("state").to_pylist()])
        shared.destroy()
    return gru.weights(state)


def _score(weights, bos: int):
    """From row_id, n_tokens, units: row_id and the model's log10 probability of the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_temporaries()
        scorer = gru.Scorer(weights.value, CLASSES, bos)
        for whole in batches:
            for batch in slices(whole, 2, SLICE // 2):
                units = np.concatenate([np.frombuffer(u.as_buffer(), "<u2") for u in batch.column(2)])
                model = scorer.score(units.astype(np.int64), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(model)], names=["row_id", *batch.schema.names[3:], "units_log"])

    return tidy(run)


def score_documents(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    docs: doc_id, text; other columns are ignored. Documents whose crc32(doc_id as text)
    mod 7 is 2 are held out, the others are learnt from; a null doc_id is learnt from.
    The model trains on all of those, in `rounds` rounds of shards of about shard_tokens
    tokens.
    Tokens are the words, A-Z lower-cased, and one end; null, empty and wordless texts
    are an end alone. base_score adds log10((c + 1) / (N + V + 1)) of the tokens, score
    is the recurrent model's log10 probability of the whole text. Repeated rows count
    and are scored each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = stage(word_counts(docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    lex, tail = lexicon(counts, head)
    shared_lex = spark.sparkContext.broadcast(lex)

    shards = max(1, -(-int(total) // (rounds * shard_tokens)))
    read = stage(read_documents(docs, shared_lex), "read-documents")
    units = stage(training_units(read, shards, rounds), "training-units", ["round"])
    flat = spark.sparkContext.broadcast(train(units, lex, shards, rounds))
    discard(units)

    passed = ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "within"]
    rows = read.select("row_id", F.col("n_tokens").alias("size"), "units", *passed)
    schema = f"row_id long, doc_id {id_type}, held_out boolean, n_tokens long, head_known long, head_log double, within double, units_log double"
    scored = rows.mapInArrow(_score(flat, lex.bos), schema)
    n = F.coalesce("n", F.lit(0))
    rest = (
        read.select("row_id", F.explode("tail").alias("word"))
        .join(tail.select("word", "n"), "word", "left")
        .groupBy("row_id")
        .agg(F.sum(F.log10(n + 1.0)).alias("tail_log"), F.count_if(n > 0).alias("tail_known"))
    )
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(rest, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("units_log") + F.col("within") + tail_log).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
