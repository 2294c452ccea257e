"""Queries without SQL, row by row against plain Python over the same tables."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lodeseek import queries
from lodeseek.functions.stemming import stem
from lodeseek.operators import chunking, evaluate

from .conftest import DATA
from .support import connect


@pytest.fixture(scope="module")
def tables():
    con = connect(DATA)
    return {name: con.execute(f"SELECT * FROM {name}").to_arrow_table().to_pylist() for name in ("documents", "embeddings", "benchmark")}


def tail_area(t, df, steps=200_000):
    """Two-sided p of a t statistic by integrating the density, the line mapped to (0, 1)."""
    x = (np.arange(steps) + 0.5) / steps
    z = abs(t) + x / (1 - x)
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return 2 * float((np.exp(log - (df + 1) / 2 * np.log1p(z * z / df)) / (1 - x) ** 2).mean())


def test_system_comparison(spark):
    rows = queries.system_comparison(spark, DATA).collect()
    sure = {r.other: r for r in queries.system_differences(spark, DATA).collect()}
    assert {r.other for r in rows} == {"vector", "keyword"} == set(sure)
    for r in rows:
        s = sure[r.other]
        assert (r.n, r.wins, r.losses) == (s.n, s.wins, s.losses) and r.t == pytest.approx(s.t, abs=1e-5)
        assert r.p == pytest.approx(tail_area(r.t, r.n - 1), abs=1e-4) and r.significant is (r.p < 0.05)
        size = abs(r.cohens_d)
        assert r.effect == ("negligible" if size < 0.2 else "small" if size < 0.5 else "medium" if size < 0.8 else "large")


def test_significance_is_strict():
    assert evaluate.significant(0.049) and not evaluate.significant(0.05) and not evaluate.significant(None) and evaluate.significant(0.05, 0.1)


def test_bootstrap(spark):
    by_system = defaultdict(list)
    for r in queries._systems(spark, DATA).filter("k = 10").orderBy("query_id").collect():
        by_system[r.system].append(r.ndcg)
    got = {r.system: r for r in queries.bootstrap_of_ndcg(spark, DATA).collect()}
    for system, values in by_system.items():
        state, means = 42, []
        for _ in range(1000):
            drawn = []
            for _ in values:
                state = (state * 6364136223846793005 + 1) % 2**64
                drawn.append(values[state % len(values)])
            means.append(sum(drawn) / len(drawn))
        means.sort()
        r = got[system]
        assert (r["mean"], r.low, r.high) == pytest.approx((sum(values) / len(values), means[25], means[975]), abs=1e-12)


def test_hash_embeddings(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in tables["documents"]}
    for r in queries.hash_embeddings(spark, DATA).collect():
        words = texts[r.doc_id].lower().split()
        v = [0.0] * 32
        for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            h = zlib.crc32(f.encode())
            v[h % 32] += 1 if h >> 20 & 1 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1
        assert r.embedding == pytest.approx([x / norm for x in v], abs=1e-6)
        assert r.summary == "32 dims [" + ", ".join(f"{x:.4f}" for x in r.embedding[:10]) + "]"


def words_of(text):
    return [t for t in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if len(t.encode()) >= 2]


def test_synthetic_query_batch(spark, tables):
    docs = {r["doc_id"]: Counter(words_of(r["text"])) for r in tables["documents"]}
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 42), 42)
    draw = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), seed) % 2**31, i)
    chosen = sorted(docs, key=draw)[:50]
    df = Counter(t for c in docs.values() for t in c)
    n = len(docs)
    want = {}
    for i in chosen:
        weights = {t: round(k * math.log(n / (df[t] + 1)), 10) for t, k in docs[i].items() if df[t] <= 0.5 * n}
        terms = sorted(weights, key=lambda t: (-weights[t], t))[: 2 + 42 % 3]
        if terms:
            want[i] = " ".join(terms)
    got = {r.query_id: r.text for r in queries.synthetic_query_batch(spark, DATA).collect()}
    assert got == want


def test_token_ids(spark, tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.enable_truncation(512)
    got = {r.doc_id: r.ids for r in queries.token_ids(spark, DATA).collect()}
    assert got == {r["doc_id"]: tokenizer.encode(r["text"]).ids for r in tables["documents"] if (r["text"] or "").strip()}


def test_stemmed_search(spark, tables):
    docs = {r["doc_id"]: [stem(w) for w in words_of(r["text"])] for r in tables["documents"]}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ws in docs.values() for t in set(ws))
    texts = {r["item_id"]: r["text"] for r in tables["benchmark"]}
    asked = {r["vec_id"]: texts[r["vec_id"] // 50 % 40] for r in tables["embeddings"] if r["vec_id"] % 50 == 0 and r["vec_id"] // 50 % 40 in texts}
    got = defaultdict(list)
    for r in queries.stemmed_search(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, text in asked.items():
        scores = {}
        for i, ws in docs.items():
            tf = Counter(ws)
            parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in {stem(w) for w in words_of(text)} if tf[t]]
            if parts:
                scores[i] = round(sum(parts), 10)
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:10]
        assert [s for _, s in got[q]] == pytest.approx([scores[i] for i in best], abs=1e-6)
        assert {i for i, _ in got[q]} == set(best) or len(set(scores.values())) < len(scores)


def pieces(text, kind, most, count):
    """Recursive form of the chunkers: units of the largest level that fits, neighbours joined while they fit."""
    levels = {"md": [r"(?m)^(?=#{1,6} )", r"(?m)^(?=```)"], "txt": [], "py": None}[kind]
    levels = [r"(?m)^(?=(?:@|def |class |async def ))", r"\n[ \t]*\n", r"\n", r"\s+"] if levels is None else levels + [r"\n[ \t]*\n\s*", r"\n", r"(?<=[.!?])\s+", r"\s+"]

    def units(part, level):
        if level == len(levels):
            return list(part)
        cuts = [m.end() for m in re.finditer(levels[level], part) if 0 < m.end() < len(part)]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)]) if a < b]

    def cut(part, level):
        part = part.strip()
        if not part:
            return []
        if count(part) <= most or len(part) == 1:
            return [part]
        out, run = [], ""
        for u in units(part, level):
            if run and count((run + u).strip()) <= most:
                run += u
            else:
                out += cut(run, level + 1) if run else []
                run = u
        return out + cut(run, level + 1)

    return cut(text, 0)


def test_document_chunks(spark, tables):
    got = defaultdict(list)
    for r in queries.document_chunks(spark, DATA).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append((r.text, r.token_count))
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    for r in tables["documents"]:
        want = pieces(r["text"] or "", ("md", "py", "txt")[r["doc_id"] % 3], 128, count)
        assert got.get(r["doc_id"], []) == [(p, count(p)) for p in want]


def test_token_sized_chunks(spark, tables):
    """No piece is larger than asked for by the library's own count, and they hold the whole text in order."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in queries.token_sized_chunks(spark, DATA).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append(r)
    texts = {r["doc_id"]: r["text"].strip() for r in tables["documents"] if (r["text"] or "").strip()}
    assert got.keys() == texts.keys()
    for i, rows in got.items():
        data = texts[i].encode()
        assert [data[r.start_byte : r.end_byte].decode() for r in rows] == [r.text for r in rows]
        assert all(r.token_count == len(tokenizer.encode(r.text, add_special_tokens=False).ids) <= 128 or len(r.text) == 1 for r in rows)
        assert "".join("".join(r.text.split()) for r in rows) == "".join(texts[i].split())
        # neighbours were not to be had in one
        whole = [tokenizer.encode(data[a.start_byte : b.end_byte].decode(), add_special_tokens=False).ids for a, b in zip(rows, rows[1:])]
        assert sum(len(w) > 128 for w in whole) >= 0.3 * len(whole)


def test_tokens_that_a_cut_parts_are_counted_again():
    """A token across a cut makes two: spans are held to their own count."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("internationalization" * 30, "a b" * 200, "日本語" * 40, "x\n\n\ny " * 50):
        for most in (3, 7, 20):
            spans = chunking.split_by_tokens(text, chunking.TEXT_LEVELS, most, tokenizer)
            assert all(len(tokenizer.encode(text[a:b], add_special_tokens=False).ids) <= most or b - a == 1 for a, b in spans)
            assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_token_sized_spans_are_encoded_twice():
    """Whole and by span, not again for the count that is returned."""
    encoded = []

    class Counting:
        def __init__(self):
            self.of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

        def encode(self, text, **options):
            encoded.append(text)
            return self.of.encode(text, **options)

    text, tokenizer = "some words, and others. " * 200, Counting()
    spans = chunking.sized_by_tokens(text, chunking.TEXT_LEVELS, 32, tokenizer)
    assert len(encoded) <= 1 + 1.1 * len(spans) and all(n <= 32 for *_, n in spans)
    assert [n for *_, n in spans] == [len(tokenizer.of.encode(text[a:b], add_special_tokens=False).ids) for a, b, _ in spans]
