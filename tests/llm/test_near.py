import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeseek.llm import ann, simhash
from lodeseek.llm.components import components

from ..conftest import DATA
from .fixtures import clashing, documents, empty, rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint); component ids by position."""
    near = lambda a, b: (a ^ b).bit_count() <= 2
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i][1], prints[j][1]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, prints):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, f, least.get(g)) for g, (i, f) in zip(group, prints)]


def test_awkward_rows_equal_brute_force(spark):
    want = sorted(brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()]), key=repr)
    for docs in (documents(spark), clashing(spark)):
        got = simhash.near_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = sorted(brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in table]))
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op8_simhash_dedup(spark, DATA).collect())
    assert got == want and all(len(r.fingerprint) == 16 for r in simhash.op8_simhash_dedup(spark, DATA).collect())


def test_growing_tables_are_not_broadcast(spark):
    """A point makes up to 69 replicas, which Spark takes for one: like postings by band, they are shuffled however small they seem."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    numbers = spark.range(50)
    assert "Broadcast" not in plan(simhash.near_fingerprints(numbers.select(F.xxhash64("id").alias("point"))))
    postings = numbers.select((F.col("id") % 9).alias("shingle"), F.col("id").alias("key"), F.col("id").alias("component"), F.lit(5).alias("size"), F.lit(0).alias("at"))
    texts = numbers.select(F.col("id").alias("key"), *[F.lit(0).cast("long").alias(c) for c in simhash.SKETCH_COLUMNS])
    assert "Broadcast" not in plan(simhash.meetings(postings, 0.8)) and "Broadcast" not in plan(simhash.all_meetings(postings, texts, 0.8))


def brute_similar(docs, similarity=0.8):
    """docs: (doc_id, text); a group for each, by position, of texts linked by shingles of five words."""
    words = [(t or "").encode().lower().split() for _, t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in words]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if group[i] != group[j] and (words[i] == words[j] or shared and shared >= similarity * len(sets[i] | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def brute_one_of_each(docs):
    """Positions of the rows that stay; for ties of doc_id any of the group's."""
    first = {}
    for at, g in enumerate(brute_similar(docs)):
        order = (docs[at][0] is None, docs[at][0] or 0)
        if g not in first or order < first[g][0]:
            first[g] = (order, at)
    return sorted(at for _, at in first.values())


def test_one_of_each(spark):
    clash = clashing(spark).selectExpr("*", "'x' AS key", "'x' AS kept_id", "'x' AS _KEPT_ID", "'x' AS kept__id", "'x' AS kept_hash", "'x' AS a")
    kept = simhash.one_of_each(clash).collect()
    want = brute_one_of_each([r[:2] for r in rows()])
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == sorted(rows()[i][:2] for i in want if rows()[i][1])
    assert len(kept) == len(want) and kept[0].own_hash == "x" and len(kept[0]) == len(clash.columns)
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_edited_copies_are_found_and_others_stay(spark):
    """Groups of a text with one word in 60 changed, of a text with half of it changed, chains, and a large group."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    new = lambda n: list(rng.choice(vocabulary, n))
    docs = []
    for n in (70, 120, 300, 1200):
        for _ in range(6):
            base = new(n)
            docs.append(base)
            for _ in range(2):
                copy = list(base)
                for at in rng.choice(n, max(n // 60, 1), replace=False):
                    copy[at] = "edited"
                docs.append(copy)
            docs.append(base[: n // 2] + new(n - n // 2))
    base = new(200)
    docs += [[*base[:i], f"other{i}", *base[i + 1 :]] for i in range(60)]
    table = [(i, " ".join(w)) for i, w in enumerate(docs)]
    kept = simhash.one_of_each(spark.createDataFrame(table, "doc_id long, text string")).collect()
    want, got = {table[i][0] for i in brute_one_of_each(table)}, {r.doc_id for r in kept}
    assert want == got


def edited_pairs():
    """Pairs of texts of similarity 0.8 or a little more by kind of edit."""
    rng = np.random.default_rng(11)
    vocabulary, chances = [f"w{i}" for i in range(3000)], 1 / np.arange(1, 3001)
    new = lambda n: list(rng.choice(vocabulary, n, p=chances / chances.sum()))
    out = {"appended": [], "cut": [], "short": [], "long": [], "scattered": []}
    for _ in range(40):
        base = new(100)
        out["appended"].append((base, base + new(20)))
        base = new(300)
        out["cut"].append((base, base[58:]))
        base = new(24)
        out["short"].append((base, base + new(5)))
        base = new(1000)
        out["long"].append((base, new(200) + base))
        base = new(300)
        copy = list(base)
        for at in rng.choice(300, 6, replace=False):
            copy[at] = "edited"
        out["scattered"].append((base, copy))
    return out


def test_links_are_found_for_any_kind_of_edit(spark):
    kinds = edited_pairs()
    pairs = [p for found in kinds.values() for p in found]
    table = [(2 * i + j, " ".join(w)) for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    want = brute_similar(table)
    of = {r.doc_id: r.component for r in simhash.similar_texts(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    linked = [i for i in range(0, len(table), 2) if want[i] == want[i + 1]]
    assert len(linked) > 150
    assert [i for i in linked if of[i] != of[i + 1]] == []


def test_texts_that_first_meet_in_the_last_round_are_compared(spark, monkeypatch):
    """Where the rounds before have no meetings, the last finds the link."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 2000, 200)]
    table = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, "others altogether")]
    rounds = []
    for name in ("meetings", "anchor_meetings"):
        whole = getattr(simhash, name)
        monkeypatch.setattr(simhash, name, lambda *args, f=whole: rounds.append(args) or f(*args).limit(0))
    of = {r.doc_id: r.component for r in simhash.similar_texts(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len(rounds) == 3 and of[1] == of[2] != of[3]


def test_close_fingerprints_are_candidates(spark, monkeypatch):
    """With the rounds of rare shingles left out, copies and texts with a last word more are linked by their fingerprints."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 2000, 3000)]
    table = [(i, " ".join(base + [f"more{i}"] * (i % 3))) for i in range(9)] + [(20, "others altogether"), (21, None), (22, "")]
    for name in ("meetings", "all_meetings"):
        whole = getattr(simhash, name)
        monkeypatch.setattr(simhash, name, lambda *args, f=whole: f(*args).limit(0))
    of = {r.doc_id: r.component for r in simhash.similar_texts(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len({of[i] for i in range(9)}) == 1 and of[20] != of[0] != of[21] == of[22]


def test_bands_of_size_lose_no_pair_that_can_be_similar(spark):
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 400, 300)
    rows = [(i, int(n), int(rng.integers(0, max(1, n // 5 + 1)))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key long, size int, at int")
    asks = {r.key: set(r.bands) for r in df.select("key", simhash._bands_to_meet(0.8).alias("bands")).collect()}
    band = {r.key: r.band for r in df.select("key", simhash._band(F.col("size")).alias("band")).collect()}
    met = df.crossJoin(df.selectExpr("key AS other_key", "size AS other_size", "at AS other_at")).filter(simhash._can_be_similar(0.8)).collect()
    assert len(met) > 1000 and all(band[r.other_key] in asks[r.key] and band[r.key] in asks[r.other_key] for r in met)
    pages = spark.createDataFrame([(1, 100, 16), (2, 102, 16)], "key long, size int, at int")  # of one template, 16 shingles of their own
    found = pages.select(F.array_contains(simhash._bands_to_meet(0.8), simhash._band(F.col("size"))).alias("meet")).collect()
    assert not any(r.meet for r in found)


def test_pages_of_a_template_and_links_among_them(spark):
    """Unlike pages of one template do not meet; those among them that are linked are found, over many sizes."""
    rng = np.random.default_rng(13)
    template = [f"t{i}" for i in range(88)]
    own = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    docs = [template + own(int(rng.integers(14, 24))) for _ in range(260)]
    for i in range(0, 200, 10):
        docs.append(docs[i] + own(2))  # nearly the same
    docs += [template[:80] + own(3) for _ in range(6)]  # short ones are linked with each other
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = brute_similar(rows)
    first, last = {}, {}
    for r in found:
        first.setdefault(r.component, set()).add(r.doc_id)
    for i, g in enumerate(group):
        last.setdefault(g, set()).add(i)
    assert sorted(map(sorted, first.values())) == sorted(map(sorted, last.values())) and len(last) < len(rows) - 20


def test_sketches_never_turn_a_similar_text_away():
    """The bound holds for every pair, and turns away most of those with twice the difference allowed."""
    rng = np.random.default_rng(3)
    away = {0.05: 0, 0.2: 0}
    for n in (1, 4, 30, 200, 900):
        for share in (0.0, 0.05, 0.11, 0.2):
            for _ in range(20):
                base = rng.integers(0, 2**64, n, dtype=np.uint64)
                edit = int(n * share)
                sets = [np.unique(np.concatenate([base[edit:], rng.integers(0, 2**64, edit, dtype=np.uint64)])), np.unique(base)]
                words = simhash.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
                apart = sum(((int(w[0]) ^ int(w[1])) % 2**64).bit_count() for w in words)
                shared, both = len(np.intersect1d(*sets)), sum(map(len, sets))
                assert shared <= (both - apart) / 2
                if n == 200 and share in away:
                    away[share] += both - apart + 1e-9 < both * 1.6 / 1.8
    assert away == {0.05: 0, 0.2: 20}
    assert [w.tolist() for w in simhash.sketches(np.zeros(0, np.uint64), np.array([0, 0]))] == [[0, 0]] * simhash.SKETCH


def test_majority_bits_are_fingerprints():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 0, 9, 300])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > len(part)) for part in np.split(hashes, np.cumsum(sizes)[:-1])]
    assert simhash.majority_bits(hashes, sizes).tolist() == want


def test_links_between_middle_members_of_two_groups_are_found(spark):
    """Of each group the middle key alone is similar to that of the other; the smallest and the largest, longer by common words, aren't."""
    rng = np.random.default_rng(6)
    new = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    key = lambda text: int(simhash.shingle_hashes(pa.array([text]), 5)[2][0])
    base, table = new(200), []
    for _ in range(2):
        middle = f"{base} {new(10)}"
        for less in (True, False):
            while True:
                common = new(32)
                if (key(f"{middle} {common}") < key(middle)) == less:
                    break
            table += [f"{middle} {common}"] + [common] * 20
        table.append(middle)
    table = list(enumerate(table))
    want = brute_similar(table)
    of = {r.doc_id: r.component for r in simhash.similar_texts(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len({of[i] for i, t in table if base in t}) == len({want[i] for i, t in table if base in t}) == 1
    assert len({(want[i], of[i]) for i, _ in table}) == len(set(want)) == 5


def test_every_close_pair_meets_once(spark):
    rng = np.random.default_rng(2)
    points = {int(x) for x in rng.integers(0, 2**63, 40)}
    for p in list(points):
        for _ in range(6):
            q = p
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                q ^= 1 << int(b)
            points.add(q)
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    got = simhash.near_fingerprints(spark.createDataFrame([(s,) for s in signed], "point long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    with pytest.raises(ValueError):
        simhash.near_fingerprints(spark.createDataFrame([(1,)], "point long"), 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (202, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 200}


def brute_search(rows, every=50, k=5):
    """Vectors are compared with those of their own length."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ok = sorted({(i, tuple(v)) for i, v in ok})
    out = {}
    for q, v in ok:
        if q % every == 0:
            score = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in ok if i != q and len(w) == len(v)]
            if score:
                out[q] = [i for _, i in sorted(score)[:k]]
    return out


def test_search_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(i, [1.0 + i % 3, 2.0, float(i % 5)]) for i in range(30)] + [(30 + i, [1.0, 2.0, 0.0]) for i in range(21)]
    table += [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [nan, 1.0, 1.0]), (64, [inf, 1.0, 1.0]), (65, [None, 1.0, 1.0]), (66, [1.0]), (100, [1.0, 1.0]), (101, [1.0, 2.0]), (150, [5.0]), (200, [1.0] * 4), (None, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS rep", "'y' AS part")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_search(table)
    assert ann.search(df.limit(0)).count() == 0
    assert [r.vec_id for r in ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()] == [1]


def test_recall_of_the_query(spark):
    data = DATA.replace("0.001", "0.1")
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute_search(table), {}
    for r in ann.op7_ann_search(spark, data).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys() and np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_routing_prunes_where_vectors_cluster(spark):
    """64 clusters, 16 partitions: most neighbours are found in less than half of the partitions."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(64, 16))
    vectors = (centres[rng.integers(0, 64, 6000)] + rng.normal(0, 0.15, (6000, 16))).astype(np.float32)
    fitted, whole = [], ann.fit_router
    ann.fit_router = lambda *a: fitted.append(whole(*a)) or fitted[0]
    try:
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = {}
        for r in ann.search(df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        ann.fit_router = whole
    x = ann._unit(vectors.astype(np.float64))
    score = x[::50] @ x.T
    score[np.arange(len(score)), np.arange(0, 6000, 50)] = -2
    want = np.argsort(-score, axis=1)[:, :5]
    assert len(fitted[0].out_bias) == ann.partitions_for(6000) == 16 and fitted[0].probes < 8
    assert np.mean([len(got[q] & set(w.tolist())) / 5 for q, w in zip(range(0, 6000, 50), want)]) >= 0.9


def test_partitions_grow_with_the_table():
    assert [ann.partitions_for(n) for n in (0, 500, 2000, 51_000, 10**9)] == [1, 1, 4, 128, 1024]


def test_wide_vectors_are_routed_however_small_the_sample(spark, monkeypatch):
    """A sample too small for the partitions wanted gives fewer of them, not one."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(24, 1024))
    x = centres[rng.integers(0, 24, 2400)] + 0.7 * rng.normal(size=(2400, 1024))
    assert len(ann.fit_router(ann._unit(x[:320]), 1024).out_bias) == 16
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 4 * 1024 * 400)
    monkeypatch.setattr(ann, "PARTITION_ROWS", 32)  # 64 partitions wanted, 300 vectors to learn from
    fitted, whole = [], ann.fit_router
    monkeypatch.setattr(ann, "fit_router", lambda *a: fitted.append(whole(*a)) or fitted[0])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    unit = ann._unit(x.astype(np.float32).astype(np.float64))
    hits = 0
    for q, ids in found.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(ids & set(np.argsort(-score)[:5].tolist()))
    assert 1 < len(fitted[0].out_bias) < 64 and fitted[0].probes < len(fitted[0].out_bias)
    assert hits >= 0.9 * 5 * len(found)


def test_queries_of_small_partitions_look_further(spark, monkeypatch):
    """Of two partitions one holds three vectors, and one is probed."""
    monkeypatch.setattr(ann, "fit_router", lambda *_: ann.Router(np.eye(2), np.zeros(2), np.eye(2), np.zeros(2)))
    vectors = [[1.0, 0.01 * i] for i in range(3)] + [[0.02 * i, 1.0] for i in range(1, 21)]
    got = {}
    for r in ann.search(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), 1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    cosine = ann._unit(np.array(vectors)) @ ann._unit(np.array(vectors)).T
    for i in range(len(vectors)):
        assert got[i] == [j for j in np.argsort(-cosine[i]).tolist() if j != i][:5]


def test_partitions_are_balanced():
    rng = np.random.default_rng(0)
    x = ann._unit(np.concatenate([rng.normal(m, 0.3, (250, 8)) for m in np.eye(8)[:4]]))
    part = ann.balanced_partition(x, ann.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1000 / 8 * 1.05) and len(set(part)) == 8
