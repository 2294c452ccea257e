"""Packing by concatenating and cutting, with two passes of prefix sums.

Pass one tokenizes each document once and writes its ids with the document's start
within its partition; the partitions' totals, a number each, give every partition its
global offset. Pass two cuts at multiples of the sequence length and gives a record for
each piece. No row is shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings, stage, text_of, tidy
from .words import per_text, slices, split_distinct

#: Words are remembered until there are so many, then only those of the last rows; longer ones than MEMO_BYTES never are.
MEMO_WORDS, MEMO_BYTES, WORDS_A_CALL = 400_000, 64, 256
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: A word that ends in a comma or full stop behind a letter or digit.
ENDED = "[0-9a-z][,.]$"
#: Bytes of text, and of ids, taken together.
TEXT_SLICE, IDS_SLICE = 3_000_000, 8_000_000
#: Rows that Spark hands over together while texts are tokenized: they lie in memory on both sides.
BATCH_ROWS = "4096"
#: The steps before the model of tokenizers whose words can be taken one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@cache
def _tokenizers(path: str):
    """Read once for each process: the tokenizer, and if it takes words one by one its bare model, the token put between words, the special strings."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    steps = json.loads(whole.to_str())
    split = (steps["pre_tokenizer"] or {}).get("pretokenizers") or [None]
    if steps["normalizer"] != WORD_NORMALIZER or split[0] != WORD_SPLIT or len(split) != 2 or split[1]["type"] != "ByteLevel" or not any(t["special"] for t in steps["added_tokens"]):
        return whole, None, None, []
    special = {i: t.content for i, t in whole.get_added_tokens_decoder().items() if t.special}
    between = max(special.items())[1]
    bare = Tokenizer(whole.model)
    bare.add_special_tokens([between])
    bare.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return whole, bare, between, [content.encode() for content in special.values()]


def _gathered(ids: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The stretches of ids with these numbers, one after another; length: of each stretch."""
    first, n = np.cumsum(length) - length, length[number]
    return ids[np.repeat(first[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class WordEncoder:
    """Ids of whole texts by those of their distinct words.

    The tokenizer drops ASCII white space and no token spans it, so a text's ids are
    those of its words one after another. It lower-cases and keeps punctuation apart
    from letters, so a word and its form with capitals or with a last comma or full
    stop share the work; words with a special string in them are left to the tokenizer
    as they stand. New words are encoded together, with a special token between them;
    those of lower-case Latin letters, on which the normalizer and the pattern have no
    effect, by the bare model. Ids are kept as little-endian bytes, two for vocabularies
    below 2^16, else four.
    """

    def __init__(self, path: str):
        self.tokenizer, self.bare, self.between, self.special = _tokenizers(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes], tokenizer) -> None:
        width, mark = self.dtype.itemsize, tokenizer.token_to_id(self.between)
        for i in range(0, len(words), WORDS_A_CALL):
            part = words[i : i + WORDS_A_CALL]
            text = f" {self.between} ".encode().join(part).decode()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = [0, *(np.flatnonzero(ids == mark) + 1).tolist(), len(ids) + 1]
            data = ids.tobytes()
            for w, a, b in zip(part, cuts, cuts[1:]):
                self.memo[w] = data[a * width : (b - 1) * width]

    def _odd(self, low: pa.Array) -> pa.Array | None:
        """Which of these lower-cased words hold a special string, None if none does."""
        marked = pc.match_substring(low, "<|")
        if not pc.any(marked).as_py():
            return None
        found = [pc.match_substring(low, s.decode()) for s in self.special]
        return pc.and_(marked, reduce(pc.or_, found))

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these distinct words one after another, and how many each has."""
        memo, low = self.memo, pc.ascii_lower(words)
        ended, stems = pc.match_substring_regex(low, ENDED), low.cast(pa.binary())
        odd = self._odd(low)
        if odd is not None:
            ended = pc.and_not(ended, odd)
        stems = pc.if_else(ended, pc.binary_slice(stems, 0, -1), stems)
        own = {}
        if odd is not None:
            stems = pc.if_else(odd, words.cast(pa.binary()), stems)
            for w in words.filter(odd).cast(pa.binary()).to_pylist():
                own[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        coded = stems.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of = [own[w] if w in own else memo.get(w) for w in distinct] if own else list(map(memo.get, distinct))
        ends_of = (b".", b",")
        plain, other = [], [w for w in ends_of if w not in memo]
        missing = [i for i, x in enumerate(of) if x is None]
        for i in missing:
            w = distinct[i]
            if w not in ends_of:
                (plain if PLAIN.fullmatch(w.decode()) else other).append(w)
        self._learn(plain, self.bare)
        self._learn(other, self.tokenizer)
        ends = [b"", *(memo[w] for w in ends_of)]  # what stands behind a stem
        for i in missing:
            of[i] = memo[distinct[i]]
        for w in (*plain, *other):
            if len(w) > MEMO_BYTES:
                del memo[w]
        if len(memo) > MEMO_WORDS:
            self.memo = {w: memo[w] for w in distinct if w in memo}
        length = np.array([len(x) for x in (*of, *ends)], np.int64) // self.dtype.itemsize
        ids = np.frombuffer(b"".join([*of, *ends]), self.dtype)
        behind = np.where(ended, np.where(pc.ends_with(low, "."), 1, 2), 0)
        parts = np.stack([coded.indices.to_numpy(), len(of) + behind], 1)
        return _gathered(ids, length, parts.ravel()), length[parts].sum(1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and how many each has."""
        if self.bare is None:
            found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            totals = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([np.zeros(0, self.dtype), *found])
            return np.insert(flat, np.cumsum(totals), end_id), totals + 1
        number, words, sizes = split_distinct(texts)
        ids, length = self.word_ids(words)
        flat = _gathered(ids, length, number)
        totals = per_text(length[number], sizes)
        return np.insert(flat, np.cumsum(totals), end_id), totals + 1


def _tokenize(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = WordEncoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1, TEXT_SLICE):
                ids, lengths = encoder.encode(batch.column(1), end_id)
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                bounds = np.concatenate([[0], np.cumsum(lengths)]) * encoder.dtype.itemsize
                binary = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(lengths), part)), pa.array(starts), pa.array(lengths), binary],
                    names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
                )

    return tidy(run)


def _cut(offsets, size: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.value
        for whole in batches:
            for batch in slices(whole, 4, IDS_SLICE):
                rows, start, length, crc, place = [], [], [], [], []
                parts, starts, tokens = (batch.column(i).to_numpy() for i in (1, 2, 3))
                for i, ids in enumerate(batch.column(4)):
                    wide = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                    first, n, at = before[int(parts[i])] + int(starts[i]), int(tokens[i]), 0
                    while at < n:
                        take = min(n - at, size - (first + at) % size)
                        rows.append(i)
                        start.append(at)
                        length.append(take)
                        crc.append(zlib.crc32(wide[at : at + take]))
                        place.append(first + at)
                        at += take
                place = np.array(place, np.int64)
                picked = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(picked), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                        batch.column(3).take(picked), pa.array(place // size), pa.array(place % size),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return tidy(run)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of `size` ids; only the last sequence is padded.

    docs: doc_id, text; other columns are ignored. Each row, null or empty text too, is
    a document: its ids and then end_id. Documents follow one another as they come, and
    each sequence boundary cuts whatever lies there. Returns a row for each piece:
    doc_id, start (the document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset. Repeated
    rows are packed each; a null doc_id stays null; an empty table gives an empty one.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() < 1 << 16 else 4
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}):
        ids = stage(
            docs.select("doc_id", text_of().alias("text")).mapInArrow(
                _tokenize(tokenizer_path, end_id), f"doc_id {id_type}, part long, part_start long, doc_tokens long, ids binary"
            ),
            "packed-ids",
        )
    offsets, at = {}, 0
    for part, total in sorted(map(tuple, ids.groupBy("part").agg(F.sum("doc_tokens")).collect())):  # a row for each partition
        offsets[part], at = at, at + total
    return ids.mapInArrow(
        _cut(spark.sparkContext.broadcast(offsets), size, width),
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
