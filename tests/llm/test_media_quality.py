import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import common, media, quality

from ..conftest import DATA
from .fixtures import clashing, documents, empty, rows
from .plain_kn import Plain


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.binary(min_size=300, max_size=300))
def test_codecs_round_trip(h, w, data):
    pixels = np.frombuffer(data, np.uint8)[: h * w * 3].reshape(h, w, 3)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.decode(media.encode_ppm(pixels[:, :, 0])) == pixels[:, :, 0]).all()


def test_headers_with_comments_and_bad_input():
    assert media.decode(b"P5 # c\n2 1\n255\nab").tolist() == [[97, 98]]
    for bad in (b"P3\n1 1\n255\n0 0 0", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_equals_exact_means():
    plane = np.arange(35.0).reshape(5, 7)
    grown = np.repeat(np.repeat(plane, 3, axis=0), 2, axis=1)  # 15 x 14: cells of 5 rows and 7 columns are whole
    assert np.allclose(media.area_resize(plane, 3, 2), grown.reshape(3, 5, 2, 7).mean((1, 3)))
    assert np.allclose(media.area_resize(np.full((1, 64), 7.0), 8, 9), 7)


def test_media_of_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark)):
        got = media.store_media(docs).collect()
        want = []
        for r in rows():
            raw = (r[1] or "").encode()
            want.append((r[0], len(raw), raw + b" " * (-len(raw) % 192 if raw else 192)))
        assert sorted(((r.doc_id, r.n_bytes, bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(np.load(io.BytesIO(r.tile)).shape == (16, 16) and len(r.dhash) == 16 for r in got)
        assert {bytes(r.media[:2]) for r in got} == {b"P6", b"BM"}
    assert media.store_media(empty(spark)).count() == 0


def test_media_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in media.op9_media_columns(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def cells(n, parts):
    """How much of each of n samples lies in each of parts equal stretches."""
    edge = [i * n / parts for i in range(parts + 1)]
    return np.array([[max(0.0, min(b, k + 1) - max(a, k)) for k in range(n)] for a, b in zip(edge, edge[1:])])


def test_media_query_equals_brute_force(spark):
    """Stored bytes, grey tile and difference hash, made with a weight for each sample and cell."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    tiles = {r.doc_id: r for r in media.store_media(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    kinds = set()
    for r in media.op9_media_columns(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        h = len(payload) // 192
        ppm = b"P6\n64 %d\n255\n" % h + payload
        rows = [payload[i * 192 : i * 192 + 192] for i in range(h)]
        swapped = [b"".join(row[j + 2 : j + 3] + row[j + 1 : j + 2] + row[j : j + 1] for j in range(0, 192, 3)) for row in reversed(rows)]
        head = b"BM" + (54 + len(payload)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (64).to_bytes(4, "little")
        head += h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(payload).to_bytes(4, "little") + (2835).to_bytes(4, "little") * 2 + bytes(8)
        stored = {hashlib.sha256(x).hexdigest(): x for x in (ppm, head + b"".join(swapped))}
        assert len(stored[r.media_sha256]) == r.media_bytes
        kinds.add(stored[r.media_sha256][:2])
        grey = np.frombuffer(payload, np.uint8).reshape(h, 64, 3).mean(axis=2)
        mean = lambda a, b: cells(h, a) @ grey @ cells(64, b).T / (h / a * 64 / b)
        tile, grid = np.load(io.BytesIO(tiles[r.doc_id].tile)), mean(8, 9)
        assert np.abs(tile - mean(16, 16)).max() < 0.5 + 1e-6
        assert r.feature == f"{tiles[r.doc_id].dhash}:{hashlib.sha256(tiles[r.doc_id].tile).hexdigest()[:16]}"
        bits, step = np.unpackbits(np.frombuffer(bytes.fromhex(tiles[r.doc_id].dhash), np.uint8)).reshape(8, 8), np.diff(grid, axis=1)
        assert (bits[np.abs(step) > 1e-6] == (step > 0)[np.abs(step) > 1e-6]).all()
    assert kinds == {b"P6", b"BM"}


def test_large_images_are_resized_in_blocks(monkeypatch):
    pixels = np.random.default_rng(0).integers(0, 256, (100, 64, 3)).astype(np.uint8)
    whole = media.features(pixels)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert media.features(pixels) == whole


TRUSTED = ["the cat sat on the mat", "the dog sat", "A cat, a Dog 12!", "日本語の文", "aaa", "", "the cat sat on the mat again and again"]
OTHERS = ["the dog on the mat", "zzz unseen жж", "日本 x", "", "T9", "a" * 50, "completely other words, none of them known: qxj"]


def fitted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    return quality.fit(docs, labels)


def test_perplexity_equals_a_plain_model(spark):
    model, plain = fitted(spark, TRUSTED), Plain(TRUSTED)
    docs = spark.createDataFrame(list(enumerate([*TRUSTED, *OTHERS, None])), "doc_id long, text string").selectExpr("'x' AS slice", "*", "'y' AS payload", "'z' AS key")
    for rows in (docs, docs.repartition(5)):
        for r in quality.perplexity(rows, model).collect():
            want = plain.perplexity(r.text or "")
            assert r.perplexity == (None if want is None else pytest.approx(want, rel=1e-9))
            assert (r.slice, r.payload, r.key) == ("x", "y", "z")
    assert quality.perplexity(docs.limit(0), model).count() == 0


def test_no_trusted_text_is_a_uniform_model(spark):
    model = fitted(spark, [])
    assert model.floor == 1 and model.table.count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab AZ1é日\n", max_size=30), max_size=5), st.integers(1, 40))
def test_pieces_hold_every_gram_once(texts, chars):
    """However texts are cut; short and long alike."""
    want = [sorted(g) for g in ([tuple(ord(c) + quality.FIRST if c and c not in "AZ1" else 0 if c is None else quality.UPPER if c != "1" else quality.DIGIT for c in s[i : i + 4]) for i in range(len(s) - 3)] for s in ([None] * 3 + list(t) + [None] for t in texts))]
    got = [[] for _ in texts]
    for symbols, ends, text in quality.pieces(texts, chars):
        gram, found = quality.distinct_grams(symbols, ends)
        assert len(gram) == len(ends) == len(text) and len(set(zip(*(x.tolist() for x in found)))) == len(found[0])
        for g, t in zip(gram.tolist(), text.tolist()):
            got[t].append(tuple(int(x[g]) for x in found))
    assert [sorted(g) for g in got] == want


def test_quality_keeps_clean_and_rejects_junk(spark):
    data = DATA.replace("0.001", "0.1")
    judged = quality.op10_quality_classifier(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    share = {r.quality: r.kept for r in judged.join(labels, "doc_id").filter("toxic = 0").groupBy("quality").agg({"keep": "count"}).withColumnRenamed("count(keep)", "kept").collect()}
    kept = {r.quality: r["count(1)"] for r in judged.filter("keep").join(labels, "doc_id").filter("toxic = 0").groupBy("quality").agg({"*": "count"}).collect()}
    assert kept[1] / share[1] > 0.985 and kept[0] / share[0] < 0.15


def test_names_that_judge_uses_inside(spark):
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(["plain words in a row", "more plain words", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, limit string, Limits_Lang string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[0].limit == "x" and got[0].Limits_Lang == "y" and got[0].keep and not got[2].keep


def test_thresholds_equal_plain_quantiles(spark):
    """Against the quantile of the perplexities themselves, within the steps they are counted in."""
    rng = np.random.default_rng(2)
    rows = [(i, ("en", "de", None)[i % 3], float(np.exp(rng.normal(2, 0.5)))) for i in range(900)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    got = {r.lang: r.threshold for r in quality.thresholds(scored, labels, 0.9, 1.1).collect()}
    for lang in ("en", "de", None):
        trusted = [p for i, of, p in rows if of == lang and i % 2 == 0 and i % 5 > 0 and i % 7]
        assert got[lang] == pytest.approx(np.quantile(trusted, 0.9) * 1.1, rel=0.02)
    judged = quality.with_thresholds(scored, labels, 0.9, 1.1).collect()
    assert all(r.threshold == got[r.lang] and r.keep == (r.perplexity <= r.threshold) for r in judged)


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 1, None), (5, 1, 0), (6, 1, 1), (None, 1, 0), (9, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for docs in (documents(spark), clashing(spark)):
        got = quality.judge(docs, labels).collect()
        assert len(got) == len(rows())
        assert all(r.perplexity is None and not r.keep for r in got if not r.text)
        assert all(r.keep for r in got if r.doc_id in (1, 4, 5))
    assert quality.judge(empty(spark), labels).count() == 0
    assert all(r.keep for r in quality.judge(documents(spark), labels.limit(0)).collect() if r.text)


def test_texts_without_trust_are_not_shuffled_to_fit(spark, tmp_path, monkeypatch):
    """Where the trusted ids are too many to broadcast, a Bloom filter leaves the others out before the shuffle."""
    before, plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    staged = quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(enumerate([*TRUSTED, *OTHERS])), "doc_id long, text string")
        labels = docs.selectExpr("doc_id", f"IF(doc_id < {len(TRUSTED)}, 1, 0) AS quality", "0 AS toxic")
        labels.union(labels).write.parquet(f"{tmp_path}/labels")
        docs.write.parquet(f"{tmp_path}/docs")
        model = quality.fit(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plans[0] and "might_contain" in plans[0]
    want = fitted(spark, TRUSTED)
    by_key = lambda m: sorted(m.table.collect(), key=lambda r: r.key)
    assert model.floor == want.floor and len(by_key(model)) == len(by_key(want))
    for a, b in zip(by_key(model), by_key(want)):
        assert (a.key, a.p, a.left) == (b.key, b.p and pytest.approx(b.p), b.left and pytest.approx(b.left))


def test_scored_slices_give_their_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert common.tidy_cogroup(lambda a, b: a + b)(1, 2) == 3 and calls == [1]
