import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import gru, lm_scoring

from ..conftest import DATA
from .fixtures import clashing, documents, empty, rows


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(scored, table):
    counts = Counter(w for i, t in table for w in tokens(t) if not held_out(i))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((i, held_out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in table),
        key=repr,
    )
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scored), key=repr)
    assert got == want


def test_base_equals_brute_force_on_awkward_rows(spark):
    table = [(r[0], r[1]) for r in rows()]
    for docs in (documents(spark), clashing(spark)):
        scored = lm_scoring.score_documents(docs, head=6, rounds=1).collect()  # a small head: most words go through the join
        check_base(scored, table)
        assert all(r.score < 0 and math.isfinite(r.score) for r in scored)


def test_empty_table(spark):
    assert lm_scoring.score_documents(empty(spark), rounds=1).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    scored = lm_scoring.score_documents(docs).filter("held_out").collect()
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def watched(monkeypatch):
    """What train() is given and gives."""
    seen, whole = [], lm_scoring.train

    def train(units, lex, *rest):
        seen.append((units.collect(), lex, whole(units, lex, *rest)))
        return seen[-1][2]

    monkeypatch.setattr(lm_scoring, "train", train)
    return seen


def test_training_reads_all_documents_to_learn_from_in_every_round(spark, monkeypatch):
    """Rows without an id, or with the same, are spread over rounds and shards; so are repeated rows."""
    learnt = next(i for i in range(1, 60) if not held_out(i))
    table = [(None, f"null {i}") for i in range(60)] + [(0, f"same {i}") for i in range(60)] + [(i, f"own {i}") for i in range(1, 60)] + [(learnt, "copies")] * 60
    seen = watched(monkeypatch)
    lm_scoring.score_documents(spark.createDataFrame(table, "doc_id long, text string"), shard_tokens=30).count()
    units, lex, _ = seen[0]
    number = {w: i for w, i in lex.index.items()}
    ids = lambda text: np.array([lex.unit[number[w]] for w in tokens(text)], "<u2").tobytes()
    assert sorted(bytes(r.units) for r in units) == sorted(ids(t) for i, t in table if not held_out(i))
    shards = -(-sum(len(tokens(t)) for i, t in table if not held_out(i)) // (30 * lm_scoring.ROUNDS))
    assert shards > 1 and {r["round"] for r in units} == set(range(lm_scoring.ROUNDS)) and {r.shard for r in units} == set(range(shards))
    copies = [(r["round"], r.shard) for r in units if bytes(r.units) == ids("copies")]
    assert len(copies) == 60 and max(copies.count(c) for c in set(copies)) <= 60 // (lm_scoring.ROUNDS * shards) + 1


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    of = lambda n: {r.doc_id: r for r in lm_scoring.score_documents(docs.repartition(n, "doc_id"), shard_tokens=2000).collect()}
    one, eight = of(1), of(8)
    assert one.keys() == eight.keys()
    assert max(abs(one[i].score - eight[i].score) / one[i].n_tokens for i in one) < 1e-6


def plain_score(text, lex, flat):
    """Token by token in double precision."""
    w = {k: v.astype(np.float64) for k, v in gru.unpack(flat, lm_scoring.CLASSES).items()}
    h, last, out = np.zeros(gru.HIDDEN), lex.bos, 0.0
    for word in tokens(text):
        place = lex.index.get(word)
        held = lex.bucket_of[place] if place is not None else lm_scoring.bucket(word)
        unit = lex.unit[place] if place is not None else lex.bucket_unit[held]
        pre = w["embed"][last] @ w["gates"] + w["gates_bias"]
        gate = 1 / (1 + np.exp(-(pre[: 2 * gru.HIDDEN] + h @ w["recur"])))
        z, r = gate[: gru.HIDDEN], gate[gru.HIDDEN :]
        new = np.tanh(pre[2 * gru.HIDDEN :] + (r * h) @ w["recur_new"])
        h, last = (1 - z) * new + z * h, unit
        c, u = divmod(int(unit), gru.CLASS)
        for logits, at in ((h @ w["to_class"] + w["class_bias"], c), (h @ w["to_unit"][c] + w["unit_bias"][c], u)):
            out += math.log10(math.e) * (logits[at] - np.log(np.exp(logits).sum()))
        if held >= 0:
            n = 10 ** lex.log_n[place] if place is not None else None
            out += math.log10(n if n is not None else lex.tail_n[word] + 1) - lex.bucket_log[held]
    return out


def test_scores_equal_a_plain_model(spark, monkeypatch):
    """With a head of 20 words, so that most words are of buckets and go through the join."""
    monkeypatch.setattr(lm_scoring, "CLASSES", 9)
    monkeypatch.setattr(lm_scoring.Lexicon.__init__, "__defaults__", (9,))
    table = [(i, f"w{i % 7} w{i % 11} rare{i} w{i % 3} w1 w2") for i in range(80)] + [(100, None), (101, ""), (102, "never seen here w1")]
    seen = watched(monkeypatch)
    scored = lm_scoring.score_documents(spark.createDataFrame(table, "doc_id long, text string"), head=20).collect()
    _, lex, flat = seen[0]
    lex.tail_n = Counter(w for i, t in table if not held_out(i) for w in tokens(t))
    texts = dict(table)
    for r in scored:
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], lex, flat), rel=1e-4)


def test_probabilities_of_units_sum_to_one():
    flat = gru.initial(np.arange(128.0)[::-1] + 1, seed=3)
    scorer = gru.Scorer(flat, 2, 0)
    prefix = np.array([5, 17, 99])
    given = scorer.score(prefix, np.array([3]))[0]
    total = sum(10 ** (scorer.score(np.append(prefix, u), np.array([4]))[0] - given) for u in range(128))
    assert total == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_batch_mates_and_carry_the_state():
    scorer = gru.Scorer(gru.initial(np.ones(128), seed=3), 2, 0)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 128, n) for n in (1, 40, 3, 700)]
    together = scorer.score(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert together == pytest.approx([scorer.score(d, np.array([len(d)]))[0] for d in docs], rel=1e-4)
    assert scorer.score(docs[1][::-1].copy(), np.array([40]))[0] != pytest.approx(together[1], abs=1e-6)


def test_training_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    counts, doc = np.ones(128), rng.integers(0, 128, 12)
    flat = gru.initial(counts, seed=5).astype(np.float64)
    first = lambda w: -gru.Scorer(w, 2, 0).score(doc, np.array([12]))[0] * np.log(10) / 12
    # one window, one lane: Adam's first step has the sign of the gradient
    lanes, gru.LANES = gru.LANES, 1
    try:
        after, n = gru.train(gru.fresh(flat.astype(np.float32)), 2, [doc], 0, rate=1e-3)
        after = gru.weights(after)
    finally:
        gru.LANES = lanes
    moved = np.flatnonzero(np.abs(after - flat) > 9e-4)
    for i in rng.choice(moved, 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (first(up) - first(down)) / 2e-4
        if abs(slope) > 1e-4:
            assert np.sign(slope) == -np.sign(after[i] - flat[i])
    assert n == 12


def test_training_learns_a_pattern():
    docs = [np.tile([3, 70, 9, 101], 50) for _ in range(40)]
    flat = gru.initial(np.ones(128))
    before = gru.Scorer(flat, 2, 0).score(docs[0], np.array([200]))[0]
    state = gru.fresh(flat)
    for _ in range(6):
        state, n = gru.train(state, 2, docs, 0, rate=0.01)
        assert n == 8000
    assert gru.Scorer(gru.weights(state), 2, 0).score(docs[0], np.array([200]))[0] > before / 2


def test_a_bucket_is_a_distribution():
    words = [b"", b"aa", b"bb"]
    lex = lm_scoring.Lexicon(words, np.array([5.0, 4, 0]), np.full(lm_scoring.BUCKETS, 3.0), np.full(lm_scoring.BUCKETS, 2.0))
    # known words of a bucket and one unseen: (3 + 2 * 1 + 1) / (3 + 2 + 1)
    assert 10 ** lex.bucket_log[lm_scoring.bucket(b"zz")] == pytest.approx(6)
    assert lex.unit[2] == lex.bucket_unit[lm_scoring.bucket(b"bb")]


def test_words_are_looked_up_as_a_column_and_equal_a_plain_lookup():
    """Of the distinct words, those of the head too, no Python object is made."""
    head = [b"", b"the", b"of", "é".encode(), b"rare", b"never"]
    lex = lm_scoring.Lexicon(head, np.array([5.0, 9, 7, 2, 1, 0]), np.full(lm_scoring.BUCKETS, 3.0), np.full(lm_scoring.BUCKETS, 2.0))
    texts = ["The of THE é unseen", "", " \n", "x ab \u00c9t\u00e9 euro\u20ac never rare"]
    got = lex.read(pa.array(texts))
    assert isinstance(got.words, pa.Array)
    want = [w for t in texts for w in tokens(t)]
    assert got.words.take(pa.array(got.number)).to_pylist() == want
    assert got.sizes.tolist() == [len(tokens(t)) for t in texts]
    places = [head.index(w) if w in head else None for w in want]
    assert got.missing[got.number].tolist() == [p is None for p in places]
    assert got.known[got.number].tolist() == [p is not None and w != b"never" for p, w in zip(places, want)]
    assert got.units[got.number].tolist() == [lex.bucket_unit[lm_scoring.bucket(w)] if p is None else lex.unit[p] for p, w in zip(places, want)]
    assert got.log_n[got.number].tolist() == [0 if p is None else lex.log_n[p] for p in places]
    held = [lm_scoring.bucket(w) if p is None else lex.bucket_of[p] for p, w in zip(places, want)]
    assert got.within[got.number] == pytest.approx([0 if b < 0 else (0 if p is None else lex.log_n[p]) - lex.bucket_log[b] for p, b in zip(places, held)])


def test_scoring_makes_few_logits_at_a_time():
    """Arrays of all logits of a step are mapped and zeroed anew each time, and leave the cache."""
    scorer, n = gru.Scorer(gru.initial(np.ones(4096)), 64, 0), 30_000
    units, sizes = np.random.default_rng(0).integers(0, 4096, 2 * n), np.full(n, 2)
    tracemalloc.start()
    try:
        scores = scorer.score(units, sizes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < n * 2 * 64 * 4 * 1.8
    few = slice(0, 50)
    assert scores[few] == pytest.approx(scorer.score(units[:100], sizes[few]), rel=1e-5)
