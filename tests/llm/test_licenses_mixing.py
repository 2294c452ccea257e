import re

import numpy as np
import pytest

from lodeseek.llm import licenses, mixing, queries

from ..conftest import DATA
from ..support import assert_same, connect
from .fixtures import clashing, documents, empty, rows


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_mix_sources"])
def test_query_equals_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name])


def test_scan_finds_planted_notices(spark):
    for docs in (documents(spark), clashing(spark)):
        found = licenses.scan_licenses(docs).collect()
        assert [(r.doc_id, r.license, r.containment) for r in found] == [(10, "Apache-2.0", 1.0)]
    assert licenses.scan_licenses(empty(spark)).count() == 0


def brute_scan(texts, templates, least=0.8):
    split = lambda t: [w for w in re.split(r"[^0-9a-z]+", t.lower()) if w]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [split(t)] for i in range(len(w) - 4)}
    return {(i, n) for i, t in texts for n, body in templates.items() if shingles(body) and len(shingles(body) & shingles(t)) >= least * len(shingles(body))}


def test_every_template_is_found_inside_other_text_and_nearly_whole(spark):
    texts = []
    for k, (name, body) in enumerate(licenses.TEMPLATES.items()):
        words = body.split()
        texts.append((k, f"some words before {body} and some words behind"))
        texts.append((100 + k, " ".join(words[: len(words) * 9 // 10])))
        texts.append((200 + k, " ".join(words[: len(words) // 2])))
    found = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {(r.doc_id, r.license) for r in found.collect()} == brute_scan(texts, licenses.TEMPLATES)


def test_notices_at_either_end_and_in_the_middle_are_all_found(spark):
    """Thousands of texts, other words beside the notice in each."""
    rng = np.random.default_rng(3)
    notices, texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", licenses.TEMPLATES["Unlicense"]], []
    for k in range(2000):
        other = [f"w{i}" for i in rng.integers(0, 10**6, 10)]
        for j, notice in enumerate(notices):
            for at in (0, 5, 10):
                texts.append((len(texts), " ".join([*other[:at], notice, *other[at:]]), j))
    found = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string, j int")).collect()
    names = ["MIT", "CC-BY-NC-4.0", "Unlicense"]
    assert sorted((r.doc_id, r.license) for r in found) == [(i, names[j]) for i, _, j in texts]


def scattered(rng, pieces, between):
    """Texts with each of the pieces once, in random order, random words between them."""
    other = lambda: [f"w{i}" for i in rng.integers(0, 10**6, between)]
    return " ".join(w for i in rng.permutation(len(pieces)) for w in [*other(), pieces[i], *other()])


def test_shingles_apart_from_one_another_are_found_as_stated(spark):
    """No two of the template's shingles side by side: two of them, so 0.9999."""
    rng, template = np.random.default_rng(4), "alpha beta gamma delta epsilon zeta"
    texts = [(i, scattered(rng, ["alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta"], 4)) for i in range(3000)]
    found = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), {"x": template}).count()
    assert found >= 2990


def test_templates_as_a_table_give_the_same(spark):
    texts = [(k, f"before {body} behind") for k, body in enumerate(licenses.TEMPLATES.values())]
    texts += [(50 + k, body) for k, body in enumerate(licenses.TEMPLATES.values())] + [(0, licenses.TEMPLATES["MIT"]), (None, licenses.TEMPLATES["ISC"]), (70, None), (71, ""), (72, "too few")]
    docs = spark.createDataFrame(texts * 2, "doc_id long, text string").selectExpr("*", "'x' AS license", "'x' AS key", "'x' AS text_a")
    table = spark.createDataFrame([*licenses.TEMPLATES.items(), ("short", "four words are few"), (None, "a b c d e f"), ("null", None)], "license string, text string")
    of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = of(licenses.scan_licenses(docs))
    assert of(licenses.scan_licenses(docs, table)) == of(licenses.scan_licenses(docs, literal_words=0)) == want and len(want) > 50
    assert licenses.scan_licenses(docs, table.limit(0)).count() == licenses.scan_licenses(docs, {}).count() == licenses.scan_licenses(empty(spark), table).count() == 0


def test_many_templates_and_others_than_ascii(spark):
    templates = {f"t{i}": " ".join(f"word{i}x{j}" for j in range(60)) for i in range(200)} | {"é": "un texte écrit à la légère"}
    docs = spark.createDataFrame([(i, f"a b c {t} d e f") for i, t in enumerate(templates.values())], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs, templates).collect()) == list(enumerate(templates))


def waterfill(sizes, weights=(5, 2, 1)):
    """Share, cap at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_targets_equal_waterfilling(spark):
    for docs in (documents(spark), clashing(spark)):
        got = mixing.mix_sources(docs).collect()
        sizes = {}
        for r in rows():
            sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        want = waterfill(sizes)
        assert len(got) == len(rows())
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r["copies"] in (int(r.rate), int(r.rate) + 1) and r["copies"] <= 3


def test_mix_comes_near_its_targets_and_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), None, f"s{i % 4}", 1) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix_sources(docs)
    for r in mixed.groupBy("source").agg({"target": "max", "copies": "count"}).collect():
        taken = sum(x["copies"] * x["size"] for x in mixed.filter(mixed.source == r.source).collect())
        assert taken == pytest.approx(r["max(target)"], rel=0.05)
    assert mixing.repeat_rows(mixed, docs.columns).count() == sum(r["copies"] for r in mixed.collect())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "x", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix_sources(blank).first()["copies"] == 0


def test_names_that_mixing_uses_inside(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2], "x", "y") for i in range(20)], "doc_id long, text string, source string, rates_source string, copy_no string")
    mixed = mixing.mix_sources(df)
    assert {r.rates_source for r in mixed.collect()} == {"x"}
    assert {r.copy_no for r in mixing.repeat_rows(mixed, df.columns).collect()} == {"y"}
