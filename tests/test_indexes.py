import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek import schemas
from lodeseek.operators import bm25, inverted_index, vector_index, vector_search
from lodeseek.operators.inverted_index import InvertedIndex
from lodeseek.operators.vector_index import VectorIndex
from lodeseek.sources.catalog import Catalog, short_shuffles


def documents(spark, rows):
    """rows: id, text."""
    full = spark.createDataFrame(rows, "doc_id long, full_text string")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schemas.DOCUMENTS).schema if f.name not in full.columns]
    return full.select("*", *others)


def zipf_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(3000)])
    return [(i, " ".join(words[np.minimum(rng.zipf(1.3, rng.integers(3, 60)) - 1, 2999)])) for i in range(n)]


def same(found, wanted):
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.collect())
    assert rows(found) == rows(wanted)


def queries_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_keyword_index_equals_bm25_after_writes(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    index = InvertedIndex(store)
    q = queries_of(spark, ["w0 w5 w100", "w1500", "w7 w7 w8", "absent", "", "w0", "W3, w4! w9"])
    assert index.search(q, 5).count() == 0  # an empty table
    texts = zipf_texts(3000)
    store.append("documents", documents(spark, texts[:2000]))
    store.append("documents", documents(spark, [*texts[2000:], (5000, None), (5001, "")]))
    assert len(index.refresh()) == 2
    live = lambda: store.scan("documents").select(F.col("doc_id").alias("id"), F.col("full_text").alias("text"))
    for k in (1, 10, 5000):
        same(index.search(q, k), bm25.search(live(), q, k))
    same(index.search(q, 7, k1=0.9, b=0.4, average=30.0), bm25.search(live(), q, 7, k1=0.9, b=0.4, average=30.0))
    best = [r.id for r in index.search(q, 3).collect()]
    store.delete("documents", documents(spark, [(i, "") for i in [*best, *range(100, 400)]]))
    store.upsert("documents", documents(spark, [(50, "w1500 w1500 w0"), (9000, "w5 w5 w5")]))
    assert len(store._manifest("documents").data) == 3
    parts = sorted(p.name for p in (tmp_path / "documents" / "index-keyword" / "built").glob("[!.]*"))
    same(index.search(q, 10), bm25.search(live(), q, 10))
    assert len(set(p.name for p in (tmp_path / "documents" / "index-keyword" / "built").glob("[!.]*")) - set(parts)) == 1  # the new segment alone
    store.compact("documents", force=True)
    same(index.search(q, 10), bm25.search(live(), q, 10))
    index.vacuum()
    assert len(list((tmp_path / "documents" / "index-keyword" / "postings").glob("w=*"))) == 1
    same(index.search(q, 10), bm25.search(live(), q, 10))


def test_keyword_index_skips_blocks(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    texts = zipf_texts(12_000, 2)
    store.append("documents", documents(spark, texts))
    index = InvertedIndex(store)
    q = queries_of(spark, ["w0 w900", "w20 w70 w80", "w1", "w300"])
    read = {r.query_id: (r.blocks, r.read) for r in index.blocks_read(q, 5).collect()}
    assert len(read) == 4 and all(0 < r < b for b, r in read.values())
    assert all(read[i][1] < 0.2 * read[i][0] for i in (0, 2, 3)), read  # bounds of several rare terms add up, so the other leaves out less
    same(index.search(q, 5), bm25.search(store.scan("documents").select(F.col("doc_id").alias("id"), F.col("full_text").alias("text")), q, 5))


def test_a_died_build_is_made_again(spark, tmp_path, monkeypatch):
    store = Catalog(spark, str(tmp_path))
    store.append("documents", documents(spark, [(1, "one two"), (2, "two three")]))
    index = InvertedIndex(store)
    with monkeypatch.context() as m:
        m.setattr(inverted_index.InvertedIndex, "_totals", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.refresh()
    assert [r.id for r in index.search(queries_of(spark, ["three"]), 5).collect()] == [2]


def vectors(spark, rows):
    return spark.createDataFrame([(int(i), [float(v) for v in row] if row is not None else None) for i, row in rows], schemas.EMBEDDINGS)


def clustered(n, width, clusters=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, width))


def recall(found, exact):
    got = {(r.query_id, r.id) for r in found.collect()}
    want = {(r.query_id, r.id) for r in exact.collect()}
    return len(got & want) / len(want)


def test_vector_index_recall_and_writes(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    x = clustered(6000, 24)
    store.append("embeddings", vectors(spark, enumerate(x[:4000])))
    store.append("embeddings", vectors(spark, [*enumerate(x[4000:], 4000), (9001, None), (9002, np.ones(5)), (9003, np.zeros(24))]))
    index = VectorIndex(store, 24, list_rows=64)
    q = vectors(spark, [(i, x[i] + 0.01) for i in range(0, 6000, 60)]).withColumnRenamed("chunk_id", "query_id")
    exact = lambda: vector_search.search(index.vectors(), q, 10)
    assert len(index.refresh()) == 2 and index.refresh() == []
    assert recall(index.search(q, 10), exact()) >= 0.95
    same(index.search(q, 10, probes=10**6), exact())
    ids, matrix = vector_search.checked(q, 10)
    _, asked, every = index.probed(matrix, 10)
    assert asked < 0.5 * every  # where vectors cluster most lists are left out
    near = [r.id for r in exact().filter("rank <= 2").collect()]
    store.delete("embeddings", vectors(spark, [(i, None) for i in near]))
    store.append("embeddings", vectors(spark, [(20_000 + i, x[i * 60] + 0.01) for i in range(100)]))
    found = index.search(q, 10)
    assert not {r.id for r in found.collect()} & set(near)
    firsts = {r.query_id: r.id for r in found.filter("rank = 1").collect()}
    assert all(firsts[i * 60] == 20_000 + i for i in range(100))
    assert recall(found, exact()) >= 0.95
    store.compact("embeddings", force=True)
    assert recall(index.search(q, 10), exact()) >= 0.95
    index.vacuum()
    assert len(list((tmp_path / "embeddings" / "index-vector-24" / "lists").glob("w=*"))) == 1


def test_vector_index_finds_k_where_there_are_k(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    x = clustered(500, 8, 10)
    store.append("embeddings", vectors(spark, enumerate(x)))
    index = VectorIndex(store, 8, list_rows=20)
    q = vectors(spark, [(0, x[0])]).withColumnRenamed("chunk_id", "query_id")
    assert index.search(q, 400, probes=1).count() == 400
    store.delete("embeddings", vectors(spark, [(i, None) for i in range(100)]))
    assert index.search(q, 400, probes=1).count() == 400 and index.search(q, 1000, probes=1).count() == 400
    with pytest.raises(ValueError):
        index.search(q, 0)
    with pytest.raises(ValueError):
        VectorIndex(store, 9).search(q, 1)
    empty = VectorIndex(Catalog(spark, str(tmp_path / "none")), 8)
    assert empty.search(q, 3).count() == 0


def test_equal_vectors_fill_a_list(spark, tmp_path):
    """A third of all rows are one vector: ties go to the smaller ids."""
    store = Catalog(spark, str(tmp_path))
    x = clustered(900, 8, 10)
    x[::3] = x[0]
    store.append("embeddings", vectors(spark, enumerate(x)))
    index = VectorIndex(store, 8, list_rows=30)
    q = vectors(spark, [(0, x[0])]).withColumnRenamed("chunk_id", "query_id")
    assert [r.id for r in index.search(q, 5).orderBy("rank").collect()] == [0, 3, 6, 9, 12]


def test_best_of_blocks_with_ties():
    rng = np.random.default_rng(8)
    score = np.round(rng.normal(size=(3, 500)), 1)
    score[0, 5] = np.nan
    best = vector_search.Best(np.array([10, 11, 12]), 7)
    for at in range(0, 500, 50):
        best.add(np.arange(3), score[:, at : at + 50], np.arange(1000 - at, 950 - at, -1))
    got = best.batch().to_pandas()
    for i, query in enumerate((10, 11, 12)):
        want = sorted((-s, 1000 - j) for j, s in enumerate(score[i]) if not np.isnan(s))[:7]
        assert [(-r.score, r.id) for r in got[got.query_id == query].itertuples()] == want


def test_timed_search_gives_the_same_rows(spark):
    from lodeseek.plans import search

    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame(zipf_texts(60), "chunk_id long, text string")
    embedded = vectors(spark, enumerate(rng.normal(size=(60, 4))))
    q = spark.createDataFrame([(i, f"w{i} w0", [float(v) for v in rng.normal(size=4)]) for i in range(3)], "query_id long, text string, embedding array<double>")
    found, timings = search.search_with_timings(chunks, embedded, q, 5)
    key = lambda r: (r.query_id, r.rank)
    assert sorted(found.collect(), key=key) == sorted(search.search_chunks(chunks, embedded, q, 5, counts=True).collect(), key=key)
    row = timings.first()
    parts = [row.vector_ms, row.keyword_ms, row.fusion_ms, row.hydrate_ms]
    assert row.n_queries == 3 and min(parts) > 0 and row.total_ms == pytest.approx(sum(parts)) and row.result_count == 15 and row.vector_count == 30


def test_an_index_part_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Postings go to the task that writes their block, once; so do texts, of which no shuffle files are left."""
    store = Catalog(spark, str(tmp_path))
    store.append("documents", documents(spark, [(i, f"apple pear{i % 3}") for i in range(20)]))
    index, plans = InvertedIndex(store), {}
    monkeypatch.setattr(index, "put", lambda kind, segment, rows, **_: plans.update({kind: rows._jdf.queryExecution().executedPlan().toString()}))
    index.build(store._manifest("documents").data[0], store._read("documents", [(store._manifest("documents").data[0], None)]))
    assert plans["postings"].count("Exchange ") == 1
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    with short_shuffles(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name, "false") == "false"
