import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek import schemas
from lodeseek.operators import embedders, lifecycle, numbering, rolling
from lodeseek.plans.indexing import crawl_and_index, index_files, index_pages
from lodeseek.sources import readers, sinks
from lodeseek.sources.catalog import Catalog, Conflict
from lodeseek.sources.memory import MemoryCatalog
from lodeseek.streaming import rolling as streams


@pytest.mark.parametrize("kind", ["files", "memory"])
def test_catalog_crud(spark, tmp_path, kind):
    store = Catalog(spark, str(tmp_path)) if kind == "files" else MemoryCatalog(spark)
    assert store.count("embeddings") == 0
    rows = lambda *r: spark.createDataFrame(list(r), schemas.EMBEDDINGS)
    store.upsert("embeddings", rows((1, [1.0]), (2, [2.0])))
    store.upsert("embeddings", rows((2, [5.0]), (3, [3.0])))
    assert [r.chunk_id for r in store.get_batch("embeddings", [3, 9, 1]).collect()] == [3, 1]
    assert store.get("embeddings", 2).first().embedding == [5.0]
    store.delete("embeddings", spark.createDataFrame([(2,), (77,)], "chunk_id long"))
    assert sorted(r.chunk_id for r in store.keys("embeddings").collect()) == [1, 3]
    store.clear()
    assert store.count("embeddings") == 0


def segments(tmp_path, table, kind):
    return sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / table / kind).glob("seq=*/w=*"))


def test_a_write_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    """Between the rows and the commit, and between the manifest's file and its rename."""
    store = Catalog(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), schemas.EMBEDDINGS)
    store.upsert("embeddings", rows((1, [1.0]), (2, [2.0])))

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(Catalog, "_commit", die)
        for write in (lambda: store.upsert("embeddings", rows((2, [5.0]))), lambda: store.overwrite("embeddings", rows((9, [9.0]))), lambda: store.delete("embeddings", rows((1, [0.0])))):
            with pytest.raises(Died):
                write()
            assert sorted((r.chunk_id, r.embedding) for r in Catalog(spark, str(tmp_path)).scan("embeddings").collect()) == [(1, [1.0]), (2, [2.0])]
    (tmp_path / "embeddings" / "_log" / ".2-abc").write_text('{"data": []')  # a manifest without its name
    store.upsert("embeddings", rows((2, [5.0]), (3, [3.0])))
    assert sorted((r.chunk_id, r.embedding) for r in store.scan("embeddings").collect()) == [(1, [1.0]), (2, [5.0]), (3, [3.0])]
    assert len(segments(tmp_path, "embeddings", "data")) == 4  # two of them of writes that died
    store.vacuum("embeddings")
    assert len(segments(tmp_path, "embeddings", "data")) == 2 and store.count("embeddings") == 3


def test_two_writers_of_one_commit(spark, tmp_path):
    store, other = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0])], schemas.EMBEDDINGS)
    store.append("embeddings", rows)
    manifest = other._manifest("embeddings")
    store.append("embeddings", spark.createDataFrame([(2, [2.0])], schemas.EMBEDDINGS))
    manifest.number += 1
    with pytest.raises(Conflict):
        other._commit("embeddings", manifest)
    assert sorted(r.chunk_id for r in other.scan("embeddings").collect()) == [1, 2]


def test_writes_append_and_compaction_keeps_the_live_rows(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    rows = lambda ids, v: spark.createDataFrame([(i, [float(v)]) for i in ids], schemas.EMBEDDINGS)
    store.append("embeddings", rows(range(100), 0))
    first = segments(tmp_path, "embeddings", "data")
    store.upsert("embeddings", rows(range(30), 1))
    assert set(first) < set(segments(tmp_path, "embeddings", "data"))  # nothing is written anew
    assert len(store._manifest("embeddings").data) == 2
    old = store._manifest("embeddings").number
    store.delete("embeddings", rows(range(25, 75), 0))  # 30 + 50 of 130 are hidden: more than 0.30
    assert len(store._manifest("embeddings").data) == 1 and not store._manifest("embeddings").deleted
    live = {r.chunk_id: r.embedding[0] for r in store.scan("embeddings").collect()}
    assert live == {i: float(i < 30) for i in [*range(25), *range(75, 100)]}
    assert store.scan("embeddings", old).count() == 100  # as it was
    store.delete("embeddings", rows([0], 0))
    assert not store.compact("embeddings") and store.compact("embeddings", force=True) and store.count("embeddings") == 49
    store.upsert("embeddings", rows([0], 7))  # a key comes back
    assert store.get("embeddings", 0).first().embedding == [7.0]


def rows_of(spark, ids, v=0.0):
    return spark.createDataFrame([(i, [float(v)]) for i in ids], schemas.EMBEDDINGS)


def jobs_of(spark, work):
    """The number of jobs that work() ran."""
    group = f"counted-{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    return len(jobs)


def test_a_get_opens_only_files_that_can_hold_the_key(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    store.append("embeddings", rows_of(spark, range(0, 1000)))
    store.append("embeddings", rows_of(spark, range(1000, 2000)))
    store.append("embeddings", rows_of(spark, range(0 - 5, 3000, 3001)))  # -5 alone
    store.append("embeddings", rows_of(spark, range(2500, 9000, 100)))
    assert len(store.candidates("embeddings", [500])) == 1 and "seq=1/" in store.candidates("embeddings", [500])[0]
    assert len(store.candidates("embeddings", [1500])) == 1 and "seq=2/" in store.candidates("embeddings", [1500])[0]
    assert store.candidates("embeddings", [777_777]) == [] and store.get("embeddings", 777_777).count() == 0
    # within the last segment's range, but none of its keys
    assert sum(bool(store.candidates("embeddings", [k])) for k in range(2501, 2600)) < 10
    assert store.get("embeddings", 2600).count() == 1 and store.get("embeddings", 2601).count() == 0
    opened = store.get("embeddings", 500).inputFiles()
    assert len(opened) == 1
    texts = Catalog(spark, str(tmp_path / "texts"))
    for n in range(3):
        texts.append("sources", spark.createDataFrame([(f"s{i}", "h", 1, True) for i in range(n, 300, 3)], schemas.SOURCES))
    opened = [len(texts.candidates("sources", [f"s{i}"])) for i in range(100)]
    assert min(opened) == 1 and sum(opened) < 115 and texts.get("sources", "s77").count() == 1
    got = texts.get_batch("sources", ["s5", None, "nothing", "s4"]).collect()
    assert [r.source_id for r in got] == ["s5", "s4"] and texts.get_batch("sources", []).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("literal, broadcast", [(10_000, 10), (0, 10), (0, 0)])
def test_deletes_are_positions(spark, tmp_path, monkeypatch, literal, broadcast):
    from lodeseek.sources import catalog

    monkeypatch.setattr(catalog, "LITERAL_HIDDEN", literal)
    monkeypatch.setattr(catalog, "BROADCAST_BLOCKS", broadcast)
    store = Catalog(spark, str(tmp_path))
    store.append("embeddings", rows_of(spark, range(70_000)))
    store.append("embeddings", rows_of(spark, range(70_000, 70_300)))
    store.delete("embeddings", rows_of(spark, [5, 64, 40_000, 70_001, 999_999]))
    store.delete("embeddings", rows_of(spark, [5, 6, 69_999]))
    store.upsert("embeddings", rows_of(spark, [7, 80_000], 9))
    gone = {5, 64, 40_000, 70_001, 6, 69_999}
    live = {r.chunk_id: r.embedding[0] for r in store.scan("embeddings").collect()}
    assert live == {i: 9.0 if i in (7, 80_000) else 0.0 for i in [*range(70_300), 80_000] if i not in gone}
    assert store.count("embeddings") == len(live) and store._manifest("embeddings").hidden == 7
    assert store.get("embeddings", 64).count() == 0 and store.get("embeddings", 7).first().embedding == [9.0]
    plan = plan_of(store.scan("embeddings"))
    assert ("Exchange" in plan) == (literal == 0) and "Window" not in plan
    if literal == 0 and broadcast:
        assert "Exchange hashpartitioning" not in plan


def test_an_upsert_of_new_keys_reads_nothing_of_the_table(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    store.append("sources", spark.createDataFrame([(f"s{i}", "h", 1, True) for i in range(0, 600, 2)], schemas.SOURCES))
    batch = lambda *ids: spark.createDataFrame([(f"s{i}", "new", 1, True) for i in ids], schemas.SOURCES)
    parts = []
    among = Catalog._among

    def seen(self, table, manifest, keys):
        found = among(self, table, manifest, keys)
        parts.append(len(found[1]))
        return found

    Catalog._among = seen
    try:
        for i in range(20):
            store.upsert("sources", batch(1000 + 3 * i, 1001 + 3 * i, 1002 + 3 * i))
        assert sum(parts) <= 20 and not store._manifest("sources").deleted  # a false positive opens a file, but hides nothing
        new = jobs_of(spark, lambda: store.upsert("sources", batch(5001)))
        store.upsert("sources", batch(4))
        assert parts[-1] >= 1 and store._manifest("sources").hidden == 1
        assert jobs_of(spark, lambda: store.count("sources")) == 0 and store.count("sources") == 361
        assert new < jobs_of(spark, lambda: store.upsert("sources", batch(6)))
    finally:
        Catalog._among = among


def test_writers_side_by_side(spark, tmp_path):
    """Ids of two writers are disjoint, and no append, upsert or delete of theirs is lost."""
    from concurrent.futures import ThreadPoolExecutor

    def work(w):
        store, taken = Catalog(spark, str(tmp_path)), []
        for i in range(4):
            first = store.reserve("embeddings", 10)
            taken += range(first, first + 10)
            store.append("embeddings", rows_of(spark, range(first, first + 10), w))
            store.upsert("embeddings", rows_of(spark, [first], 100 + w))
            store.delete("embeddings", rows_of(spark, [first + 1]))
        return taken

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(work, [1, 2])
    assert len(one) == len(two) == 40 and not set(one) & set(two)
    live = {r.chunk_id: r.embedding[0] for r in Catalog(spark, str(tmp_path)).scan("embeddings").collect()}
    assert set(live) == {i for ids in (one, two) for at, i in enumerate(ids) if at % 10 != 1}
    assert all(live[i] == (w if at % 10 else 100 + w) for w, ids in ((1, one), (2, two)) for at, i in enumerate(ids) if at % 10 != 1)


def test_matching_shuffles_none_of_the_store(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    store.append("embeddings", rows_of(spark, range(1000)))
    store.append("embeddings", rows_of(spark, range(1000, 2000)))
    keys = spark.createDataFrame([(3,), (4,), (None,), (77_777,)], "anything long")
    found = store.matching("embeddings", keys)
    assert sorted(r.chunk_id for r in found.collect()) == [3, 4] and len(found.inputFiles()) < len(store.scan("embeddings").inputFiles())
    assert "Exchange hashpartitioning" not in plan_of(found)
    assert store.matching("embeddings", keys.filter("anything > 70000")).count() == 0


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    for number in (0, 0, 1, 0):
        store.append("embeddings", rows_of(spark, [number]), batch=("s", number))
    store.append("embeddings", rows_of(spark, [5]), batch=("t", 0))
    store.upsert("embeddings", rows_of(spark, [0], 1), batch=("s", 1))
    assert sorted((r.chunk_id, r.embedding[0]) for r in store.scan("embeddings").collect()) == [(0, 0), (1, 0), (5, 0)]


@pytest.mark.parametrize("dies_at", ["documents", "embeddings", "complete", None])
def test_a_page_batch_replayed_after_a_crash_changes_nothing(spark, tmp_path, monkeypatch, dies_at):
    """The job dies before a commit, or after the last one; the stream hands the same batch over again."""
    store = Catalog(spark, str(tmp_path))
    load = lambda: embedders.hash_embedder(8)
    pages = spark.createDataFrame([(f"u{i}", f"<p>page number {i}</p>") for i in range(4)], "url string, html string")
    index_pages(store, pages.limit(1), load, 0, batch=("crawl", 0))
    commit = Catalog._commit

    class Died(Exception):
        pass

    def dying(self, table, manifest):
        last = table == "sources" and manifest.batches.get("crawl") == 1
        if (dies_at == "complete" and last) or (table == dies_at and manifest.data and manifest.next_id and len(manifest.data) > 1):
            raise Died
        commit(self, table, manifest)

    if dies_at:
        with monkeypatch.context() as m:
            m.setattr(Catalog, "_commit", dying)
            try:
                index_pages(store, pages, load, 1, batch=("crawl", 1))
            except Died:
                pass
        index_pages(store, pages, load, 1, batch=("crawl", 1))
    else:
        index_pages(store, pages, load, 1, batch=("crawl", 1))
    state = {t: store._manifest(t).number for t in schemas.TABLES}
    assert index_pages(store, pages, load, 2, batch=("crawl", 1)).count() == 0
    assert {t: store._manifest(t).number for t in schemas.TABLES} == state
    assert sorted(r.title for r in store.scan("documents").collect()) == ["u0", "u1", "u2", "u3"]
    assert store.count("chunks") == store.count("embeddings") == 4 and store.scan("sources").filter("complete").count() == 4
    ids = [r.chunk_id for r in store.scan("chunks").collect()]
    assert len(set(ids)) == 4


def test_the_last_of_repeated_keys_wins(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "h1", 1, True, 5), ("a", "h2", 1, True, 9), ("a", "h3", 1, True, 7)], schemas.SOURCES + ", n int")
    store.upsert("sources", rows, order="n")
    assert [r.content_hash for r in store.scan("sources").collect()] == ["h2"]
    table = spark.createDataFrame([(1, "x", 0)], "id long, v string, n int")
    more = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1)], "id long, v string, n int")
    assert sorted((r.id, r.v) for r in lifecycle.upsert(table, more, "id", "n").collect()) == [(1, "a"), (2, "c")]


def test_sources_are_registered_and_completed(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    store.register("a", "h")
    assert store.scan("sources").first().complete is False
    store.complete("a")
    assert [tuple(r) for r in store.scan("sources").collect()] == [("a", "h", 1, True)]
    with pytest.raises(lifecycle.NotFound):
        store.complete("b")


def test_compacted_and_dump(spark):
    chunks = spark.createDataFrame([(i, f"f{i}", "s", "x" * (150 if i == 2 else 3)) for i in range(20)], "chunk_id long, filename string, source string, text string")
    gone = lambda n: chunks.filter(F.col("chunk_id") < n).select("chunk_id")
    assert [lifecycle.compacted(chunks, gone(n)).count() for n in (0, 6, 7)] == [20, 20, 13]
    assert lifecycle.compacted(chunks, gone(1), force=True).count() == 19
    vectors = chunks.selectExpr("chunk_id", "array(1f, 2f) AS embedding")
    text = lifecycle.dump(chunks, vectors, gone(2))
    assert "chunks: 20" in text and "deleted: 2" in text and "dimension: 2" in text and "[2] f2 (s)" in text and "x" * 100 + "..." in text and text.count("\n[") == 10
    assert "no chunks" in lifecycle.dump(chunks.limit(0), vectors.limit(0), gone(0))


def test_pages_are_crawled_and_indexed(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    pages = [("https://s/a", '<p>start</p><a href="/b">b</a><a href="/dead">d</a>'), ("https://s/b", "<p>second page</p>"), ("https://s/c", "<p>not linked</p>"), ("https://s/dead", "  ")]
    df = spark.createDataFrame(pages, "url string, html string")
    done = crawl_and_index(store, df, ["https://s/a"], 3, lambda: embedders.hash_embedder(8), 1)
    assert {r.source_id: r.action for r in done.collect()} == {"web:https://s/a": "add", "web:https://s/b": "add"}
    assert sorted(r.title for r in store.scan("documents").collect()) == ["https://s/a", "https://s/b"]
    more = index_pages(store, df.selectExpr("*", "url <> 'https://s/b' AS success"), lambda: embedders.hash_embedder(8), 2)
    assert {r.source_id: r.action for r in more.collect()} == {"web:https://s/a": "skip", "web:https://s/c": "add"}


def test_embedding_cache_and_lines_with_ids(spark, tmp_path):
    values = np.arange(10, dtype="<f4")
    (tmp_path / "cache.bin").write_bytes(np.array([3, 2, 2], "<u8").tobytes() + values.tobytes())
    rows = readers.read_embedding_cache(spark, str(tmp_path / "cache.bin")).collect()
    assert [(r.kind, r.position, r.embedding) for r in rows] == [("document", 0, [0, 1]), ("document", 1, [2, 3]), ("document", 2, [4, 5]), ("query", 0, [6, 7]), ("query", 1, [8, 9])]
    (tmp_path / "short.bin").write_bytes(np.array([3, 2, 2], "<u8").tobytes() + values[:9].tobytes())
    with pytest.raises(Exception):
        readers.read_embedding_cache(spark, str(tmp_path / "short.bin")).collect()
    (tmp_path / "ids.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n{"_id": "2"}\n')
    assert [tuple(r) for r in readers.read_jsonl_with_ids(spark, str(tmp_path / "ids.jsonl")).collect()] == [("1", "t", "x"), ("2", None, None)]
    (tmp_path / "blank.jsonl").write_text('{"_id": "1"}\n\n{"_id": "2"}\n')
    with pytest.raises(Exception):
        readers.read_jsonl_with_ids(spark, str(tmp_path / "blank.jsonl")).collect()


@pytest.mark.parametrize("kind", ["files", "memory"])
def test_index_files_adds_skips_updates(spark, tmp_path, kind):
    store = Catalog(spark, str(tmp_path)) if kind == "files" else MemoryCatalog(spark)
    load = lambda: embedders.hash_embedder(8)
    files = lambda *r: spark.createDataFrame(list(r), "source_id string, path string, text string")
    first = index_files(store, files(("a", "a.txt", "one two three."), ("b", "b.md", "# t\nfour five"), ("c", "c.txt", "  ")), load, 1)
    assert {r.source_id: r.action for r in first.collect()} == {"a": "add", "b": "add"}
    second = index_files(store, files(("a", "a.txt", "one two three."), ("b", "b.md", "# t\nchanged")), load, 2)
    assert {r.source_id: r.action for r in second.collect()} == {"a": "skip", "b": "update"}
    assert store.count("documents") == 2 and store.count("embeddings") == store.count("chunks")
    assert store.scan("sources").filter("complete").count() == 2
    assert store.scan("documents").filter("source_id = 'b'").first().full_text == "# t\nchanged"
    assert lifecycle.load({t: store.scan(t) for t in schemas.TABLES}, 8)["embeddings"].count() == store.count("chunks")


@pytest.mark.parametrize("deleted, needed", [(30, False), (40, True), (0, False)])
def test_compaction_boundary(spark, deleted, needed):
    chunks = spark.range(100).withColumnRenamed("id", "chunk_id")
    assert lifecycle.compaction_stats(chunks, chunks.filter(F.col("chunk_id") < deleted)).first().needed is needed


def test_compaction_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long")
    assert lifecycle.compaction_stats(none, none).first().ratio == 0


def test_numbers_are_dense_and_in_order(spark):
    got = numbering.number(spark.range(50).select((F.lit(100) - F.col("id")).alias("k")), ["k"], "n", 7).orderBy("k").collect()
    assert [r.n for r in got] == list(range(7, 57))


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "title": "t", "text": "x"}\n\n{"doc_id": "2"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"doc_id": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "q.tsv").write_text("# note\n\nq1\td1\t2\nq1\td2\t1\n")
    assert readers.read_qrels(spark, str(tmp_path / "q.tsv")).count() == 2
    (tmp_path / "h.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nshort\nq1\td1\t2\n")
    assert [r.relevance for r in readers.read_qrels(spark, str(tmp_path / "h.tsv"), header=True).collect()] == [2]
    (tmp_path / "short.tsv").write_text("q1\td1\n")
    with pytest.raises(Exception):
        readers.read_qrels(spark, str(tmp_path / "short.tsv")).collect()
    files = tmp_path / "files" / "sub"
    files.mkdir(parents=True)
    (files / "a.txt").write_text("hello")
    (files / "b.bin").write_bytes(b"a\0b")
    assert [(r.relative_path, r.content) for r in readers.read_folder(spark, str(tmp_path / "files")).collect()] == [("sub/a.txt", "hello")]


def test_sinks(spark):
    rows = spark.createDataFrame([(1, 0.5, None, "some text here")], "rank int, score double, title string, text string")
    assert sinks.as_json(rows).first().json == '{"rank":1,"score":0.5,"text":"some text here"}'
    assert "untitled" in sinks.as_listing(rows).first().line


def test_rolling_window_edges(spark):
    rows = spark.createDataFrame([(1, "a", 0, 10.0), (2, "a", 40, 20.0), (3, "a", 100, 30.0)], "id long, k string, s long, duration_ms double")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    found = rolling.snapshot(rows, "k", 60).first()
    assert found.n == 2 and found.average == 25 and found.throughput == pytest.approx(2 / 60)  # exactly 60 s old still counts
    assert rolling.newest(rows, "k", 1).first().id == 3


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_ms"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rolled").select("event_type", "window_start", "n").collect())) == sorted(
        map(tuple, streams.windowed(events, "event_type").select("event_type", "window_start", "n").collect())
    )


def test_pages_are_indexed_by_batches(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<p>x</p>")], "url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.index_pages(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), lambda b, _: seen.append(b.count()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sum(seen) == 1


def test_batch_figures_and_manifest(spark):
    schema = "batch_id int, active boolean, completed_at long, n_docs long, n_chunks long, n_tokens long, total_ms long"
    rows = [(1, False, 10, 2, 4, 100, 1000), (2, False, 20, 1, 3, 50, 500), (3, True, None, 1, 2, 10, 2000), (4, False, 30, None, None, None, None)]
    batches = spark.createDataFrame(rows, schema)
    assert tuple(rolling.batch_totals(batches).first()) == (4, 9, 160, 160 // 9)
    assert tuple(rolling.batch_totals(batches.limit(0)).first()) == (0, 0, 0, 0)
    assert tuple(rolling.live_rates(batches).first()) == (5, 1, 1000, True)
    assert tuple(rolling.live_rates(batches.filter("NOT active")).first()) == (100, 6, 500 / 3, False)  # the latest with figures
    idle = spark.createDataFrame([(9, True, None, 0, 0, 0, 100)], schema)  # an active batch without chunks doesn't count
    assert rolling.live_rates(batches.filter("NOT active").union(idle)).first().chunks_per_s == 6
    assert rolling.live_rates(idle).count() == 0
    instant = spark.createDataFrame([(1, True, None, 1, 2, 9, 0), (5, True, None, 1, 7, 9, 7)], schema)
    assert tuple(rolling.live_rates(instant).first()) == (0, 0, 0, True)
    assert rolling.search_records(spark.createDataFrame([(1.0, 2.0, None, 4.0)], "vector_ms double, keyword_ms double, fusion_ms double, hydrate_ms double")).first().total_ms == 7
    none = {t: spark.createDataFrame([], schemas.TABLES[t]) for t in schemas.TABLES}
    row = lifecycle.manifest(none["documents"], none["chunks"], none["embeddings"], schemas.SCHEMA_VERSION).first()
    assert (row.version, row.n_docs, row.n_chunks, row.dimension) == (2, 0, 0, 0)
    assert schemas.compatible(1) and not schemas.compatible(3) and schemas.needs_migration(1)


def test_query_batch_is_seeded(spark):
    from lodeseek.operators import synthetic

    docs = spark.createDataFrame([(i, f"word{i} other{i % 3} common") for i in range(12)], "id long, text string")
    first = synthetic.query_batch(docs, 4)[0].orderBy("query_id").collect()
    assert len(first) == 4 and first == synthetic.query_batch(docs, 4)[0].orderBy("query_id").collect()
    assert synthetic.query_batch(docs, 4, seed=7)[0].orderBy("query_id").collect() != first


def test_tokenize(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodeseek.operators.tokenize import tokenize

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "some words here " * 50), (2, "x")], "id long, text string")
    got = {r.id: r.ids for r in tokenize(docs, path, 20).collect()}
    assert got[1] == Tokenizer.from_file(path).encode("some words here " * 50).ids[:20] and len(got[2]) == 1
    with pytest.raises(Exception):
        tokenize(spark.createDataFrame([(1, " ")], "id long, text string"), path).collect()
