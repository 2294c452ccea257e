import math

import pytest

from lodeseek.operators import evaluate


def frames(spark, results, qrels):
    return (
        spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(results)], "query_id long, id long, rank int"),
        spark.createDataFrame([(1, i, r) for i, r in qrels.items()], "query_id long, id long, relevance int"),
    )


def at(spark, results, qrels, k):
    return evaluate.metrics_at_k(*frames(spark, results, qrels), (k,)).first()


def test_precision_divides_by_k(spark):
    for k, want in ((1, 1.0), (2, 0.5), (3, 2 / 3), (5, 0.4)):
        assert at(spark, [1, 2, 3], {1: 1, 3: 1}, k).precision == pytest.approx(want)


def test_ap_rr_f1_and_defaults(spark):
    found = evaluate.ranking_metrics(*frames(spark, [1, 2, 3], {1: 1, 3: 1})).first()
    assert found.ap == pytest.approx(0.8333, abs=1e-3) and found.rr == 1
    assert evaluate.ranking_metrics(*frames(spark, [2], {1: 1})).first().rr == 0
    row = at(spark, [1, 2], {1: 1, 3: 1}, 2)
    assert row.precision == 0.5 and row.recall == 0.5 and row.f1 == 0.5
    none = at(spark, [1], {1: 0}, 1)
    assert none.ndcg == 1 and none.recall == 1


def test_ndcg_is_one_for_the_ideal_order(spark):
    assert at(spark, [1, 2, 3], {1: 2, 2: 1}, 3).ndcg == pytest.approx(1)
    assert at(spark, [3, 2, 1], {1: 2, 2: 1}, 3).ndcg < 1


def test_p_values():
    assert evaluate.t_test_p(0.0, 10) == pytest.approx(1)
    assert evaluate.t_test_p(2.262157, 10) == pytest.approx(0.05, abs=1e-5)  # table value for 9 degrees of freedom
    assert evaluate.t_test_p(12.7062, 2) == pytest.approx(0.05, abs=1e-5)
    assert evaluate.t_test_p(1.959964, 1000) == pytest.approx(0.05, abs=1e-5)
    assert evaluate.t_test_p(None, 1) is None


def test_effect_labels_and_bootstrap():
    assert [evaluate.effect_label(d) for d in (0.1, 0.2, -0.5, 0.9)] == ["negligible", "small", "medium", "large"]
    mean, low, high = evaluate.bootstrap_interval([1.0, 2.0, 3.0, 4.0])
    assert mean == 2.5 and 1 <= low <= mean <= high <= 4
    assert evaluate.bootstrap_interval([1.0, 2.0]) == evaluate.bootstrap_interval([1.0, 2.0])
    assert math.isnan(evaluate.bootstrap_interval([])[0])


def test_paired_without_spread(spark):
    rows = spark.createDataFrame([("x", 2.0, 1.0), ("x", 3.0, 2.0), ("y", 1.0, 1.0)], "g string, a double, b double")
    found = {r.g: r for r in evaluate.paired(rows, ["g"]).collect()}
    assert found["x"].t == 0 and found["x"].wins == 2 and found["y"].t is None and found["y"].cohens_d == 0


def test_jumps_in_the_generator():
    states = evaluate.draws(42, 1000)
    assert [evaluate.state_after(42, n) for n in (1, 2, 17, 1000)] == [int(states[n - 1]) for n in (1, 2, 17, 1000)] and evaluate.state_after(42, 0) == 42


def test_bootstrap_as_a_job_equals_that_of_a_list(spark, monkeypatch):
    import random

    monkeypatch.setattr(evaluate, "DRAWS", 64)  # a resample in several blocks
    rng = random.Random(1)
    groups = {"a": 150, "b": 1, None: 7, "c": 64}
    rows = [(g, i, rng.random()) for g, n in groups.items() for i in range(n)] + [("a", 999, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(5)
    got = {r.g: (r["mean"], r.low, r.high) for r in evaluate.bootstrap(df, "g", "v", "i", samples=200, seed=9, level=0.9).collect()}
    assert got.keys() == groups.keys()
    for g in groups:
        values = [v for of, _, v in rows if of == g and v is not None]
        assert got[g] == pytest.approx(evaluate.bootstrap_interval(values, 200, 9, 0.9), abs=1e-12)


def test_bootstrap_never_broadcasts_what_was_drawn(spark, monkeypatch):
    """It is `samples` times the values, which Spark does not see: few values are broadcast to it, more are met in a shuffle."""
    df = spark.createDataFrame([(g, i, float(i % 7)) for g in "ab" for i in range(40)], "g string, i long, v double")
    found = []
    for most, hint in ((100, "rightHint=(strategy=broadcast)"), (10, "leftHint=(strategy=merge)")):
        monkeypatch.setattr(evaluate, "MAX_VALUES", most)
        of = evaluate.bootstrap(df, "g", "v", "i", samples=50)
        joins = [x for x in of._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "place#" in x]
        assert len(joins) == 1 and hint in joins[0]
        found.append(sorted((r.g, round(r.low, 10), round(r.high, 10)) for r in of.collect()))
    assert found[0] == found[1]
