"""What must not grow with queries times rows, and results across the bounds of a batch or a pass."""

import inspect
import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeseek.functions import html
from lodeseek.functions.slices import cuts
from lodeseek.llm import quality
from lodeseek.operators import bm25, evaluate, rolling, synthetic, term_table, tokenize, vector_index, vector_search
from lodeseek.sources.catalog import Catalog


def plain_bm25(texts, queries, k):
    """query_id, id, score, rank by brute force; texts and queries: (id, text)."""
    docs = [(i, t.lower().split()) for i, t in texts]
    mean = sum(len(t) for _, t in docs) / len(docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for q, text in queries:
        scored = []
        for i, ts in docs:
            tf = Counter(ts)
            parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t in sorted(set(text.split())) if tf[t]]
            if parts:
                scored.append((-round(sum(parts), 10), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_keyword_search_in_passes_and_of_equal_queries(spark, monkeypatch):
    """More texts than a pass holds, queries with the same terms, many copies of a document, small batches."""
    rng = np.random.default_rng(4)
    texts = [(f"d{i:03}", " ".join(f"w{w}" for w in (rng.zipf(1.4, 30) % 90 + 10))) for i in range(150)]
    texts += [(f"c{i:03}", texts[7][1]) for i in range(60)]
    queries = [(i, " ".join(f"w{w}" for w in rng.permutation(90)[:5] + 10)) for i in range(30)]
    queries += [(100 + i, " ".join(reversed(text.split()))) for i, text in queries]
    monkeypatch.setattr(bm25, "MAX_QUERIES", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        found = bm25.search(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(queries, "query_id long, text string"), 4)
        got = sorted((r.query_id, r.id, r.score, r.rank) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_bm25(texts, queries, 4)
    assert [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_keyword_search_of_joined_documents(spark):
    """Documents that a join leaves out take no place among the k best: nothing is scored beneath the join."""
    texts = [(i, f"apple {'pear ' * (i % 5)}plum{i}") for i in range(60)]
    asked = [(1, "apple pear")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(1)
    some = docs.join(spark.createDataFrame([(i,) for i in range(1, 60, 9)], "id long"), "id")
    found = bm25.search(some, spark.createDataFrame(asked, "query_id long, text string"), 3)
    want = plain_bm25([t for t in texts if t[0] % 9 == 1], asked, 3)
    assert [(q, i, r) for q, i, _, r in sorted(map(tuple, found.collect()), key=lambda r: r[3])] == [(q, i, r) for q, i, _, r in sorted(want, key=lambda r: r[3])]


def test_keyword_search_shuffles_no_postings(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(i, "some words") for i in range(50)], "query_id long, text string")
    plan = bm25.search(docs, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and "Aggregate [id" not in plan


def test_unclosed_character_references_stay():
    """As in the SQL of html_text_and_links: a reference that was cut before its semicolon is text."""
    page = '<body><a href="/x?a=1&copy=2">AT&T</a><h1>a &amp;&amp</h1><p>&lt;b&gt; &copy; &#169; &amp;copy; &lt</p></body>'
    assert html.parse(page, "https://a.example/") == ("AT&T\na &&amp\n<b> © © &copy; &lt", ["https://a.example/x?a=1&copy=2"])


def test_vector_search_of_more_queries_than_a_pass_holds(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8))
    x[::5] = x[0]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id long, embedding array<float>")
    store = Catalog(spark, str(tmp_path))
    store.append("embeddings", rows)
    index = vector_index.VectorIndex(store, 8, list_rows=20)
    vectors, asked = rows.withColumnRenamed("chunk_id", "id"), rows.withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    want = key(vector_search.search(vectors, asked, 5))
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(vector_search, "CELLS", 3_000)
    assert len(vector_search.batches(asked, 5)[0]) > 1
    got = key(vector_search.search(vectors, asked, 5)), key(index.search(asked, 5, probes=10**6))
    for found in got:
        assert [r[:3] for r in found] == [r[:3] for r in want] and np.allclose([r[3] for r in found], [r[3] for r in want])


def test_lists_are_fitted_in_bounded_memory():
    rng = np.random.default_rng(7)
    sample = vector_index.unit(rng.normal(size=(20_000, 16)))
    tracemalloc.start()
    centroids = vector_index.fit_lists(sample, 1000)
    probes = vector_index.probes_needed(sample, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1 <= probes <= 1000 and peak < 60_000_000  # 160 MB for the whole table of samples by lists


def test_best_order_is_counted_not_sorted(spark):
    """Ideal gains from the number of each relevance: as from the sorted judgments, and without a window over them."""
    rng = np.random.default_rng(9)
    judged = [(q, i, int(rng.integers(0, 4))) for q in range(4) for i in range(30 + q)]
    results = [(q, int(i), r) for q in range(4) for r, i in enumerate(rng.permutation(40)[:12], 1)]
    found = evaluate.metrics_at_k(
        spark.createDataFrame(results, "query_id long, id long, rank int"), spark.createDataFrame(judged, "query_id long, id long, relevance int"), (1, 5, 10)
    )
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    gain = lambda rels: sum((2**x - 1) / math.log2(r + 1) for r, x in enumerate(rels, 1))
    of = {(q, i): x for q, i, x in judged}
    for row in found.collect():
        best = sorted((x for q, _, x in judged if q == row.query_id), reverse=True)[: row.k]
        got = [of.get((q, i), 0) for q, i, r in results if q == row.query_id and r <= row.k]
        assert math.isclose(row.ndcg, gain(got) / gain(best), rel_tol=1e-9, abs_tol=1e-12)


def test_synthetic_queries_in_passes(spark, monkeypatch):
    """The same queries and judgments, however many terms a pass takes; terms meet documents without a shuffle of postings."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in rng.zipf(1.5, 25) % 60 + 10)) for i in range(200)], "id long, text string")
    rows = lambda x: [sorted(map(tuple, t.collect())) for t in x]
    want = rows(synthetic.queries_of(docs, docs.filter("id % 5 = 0"), 4))
    monkeypatch.setattr(synthetic, "MAX_PAIRS", 50)
    assert rows(synthetic.queries_of(docs, docs.filter("id % 5 = 0"), 4)) == want
    texts, words = dict(want[0]), {r.id: set(r.text.split()) for r in docs.collect()}
    plain = [(q, i, 2 if q == i else 1) for q, t in texts.items() for i, held in words.items() if q == i or 2 * len(held & set(t.split())) >= len(t.split())]
    assert len(texts) == 40 and want[1] == sorted(plain)


def test_judgments_are_sent_on_in_small_batches(monkeypatch):
    """However many queries a batch of documents meets: pieces of whole documents, of bounded size."""
    monkeypatch.setattr(term_table, "CELLS", 1_000)
    lists = [["aa", f"t{i}"] for i in range(400)]
    shared = SimpleNamespace(value=(term_table.TermTable(lists), pa.array(range(1000, 1400)), np.full(400, 2)))
    docs = [["aa"], None, [], ["bb"], ["aa", "aa", "t7"]] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(docs, pa.list_(pa.string()))], names=["id", "tokens"])
    found = list(synthetic._sharing(shared)(iter([batch])))
    assert max(b.num_rows for b in found) <= 1_000 and sum(b.num_rows for b in found) == 120 * 400
    assert sorted({i for b in found for i in b.column("id").to_pylist()}) == [i for i in range(300) if i % 5 in (0, 4)]


def test_batches_are_cut_by_bytes_and_rows():
    """Python objects are made of slices of a batch: by bytes, by rows, and a long text alone."""
    texts = pa.array(["a" * 10] * 5 + ["b" * 1000, None, ""] + ["c"] * 7)
    found = list(cuts(texts, 25, 4))
    assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(texts)
    assert all(b - a <= 4 and (b - a == 1 or sum(len(t or "") for t in texts[a:b].to_pylist()) <= 25) for a, b in found)
    assert list(cuts(texts[3:6], 25, 4)) == [(0, 2), (2, 3)] and list(cuts(texts[:0])) == []


def test_token_ids_of_long_texts_are_cut(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.enable_truncation(16)
    texts = ["some words " * n for n in (1, 3, 4000)] * 5
    got = tokenize.tokenize(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), path, 16).collect()
    assert [r.ids for r in sorted(got)] == [plain.encode(t).ids for t in texts]


def test_quality_model_is_fitted_on_all_trusted_texts():
    assert inspect.signature(quality.fit).parameters["fit_rows"].default is None
    assert inspect.signature(quality.judge).parameters["fit_rows"].default is None


def test_trailing_figures_of_dense_samples(spark):
    """Many samples a second, null durations and a null kind: as by brute force, and no window over the samples themselves."""
    rng = np.random.default_rng(2)
    rows = [(i, [None, "a", "b"][i % 3], 1_700_000_000 + float(rng.integers(0, 400)) / 4, None if i % 7 == 0 else float(i % 11)) for i in range(900)]
    samples = spark.createDataFrame(rows, "id long, kind string, t double, duration_ms double").withColumn("ts", F.col("t").cast("timestamp"))
    found = rolling.trailing(samples, "kind", 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [kind") > plan.index("Window [")  # what the window reads is summed up
    got = {r.id: (r.n, r.average) for r in found.collect()}
    for i, kind, t, _ in rows:
        near = [v for _, k, u, v in rows if k == kind and int(t) - 10 <= int(u) <= int(t)]
        some = [v for v in near if v is not None]
        assert got[i][0] == len(near) and math.isclose(got[i][1], sum(some) / len(some), rel_tol=1e-12)
    assert len(got) == len(rows)
