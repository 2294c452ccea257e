import numpy as np
import pytest

from lodeseek.llm import whitening

from ..conftest import DATA


def plain(vectors, most=8):
    """n, deviations, whitened, explained by numpy with whole numbers."""
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = x * n - sums
    cov = (centred.T @ centred / n**3).astype(np.float64)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u.T[::-1][:most]
    return n, [int(d) for d in (centred**2).sum(axis=1)], (centred / n).astype(np.float64) @ u.T / np.sqrt(e), e / np.trace(cov)


def check(rows, vectors, ids):
    n, deviations, whitened, explained = plain(vectors)
    k = whitened.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == n * k
    table = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.allclose(table * sign, whitened, atol=1e-6)
    for at, i in enumerate(ids):
        for c in range(k):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == deviations[at] and r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_query_equals_plain_whitening(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    check(whitening.op12_embedding_whitening(spark, DATA).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_left_out_narrow_and_clashing(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(v)) for v in rng.normal(size=3)] for _ in range(40)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = [(i, v, "x", "x", "x") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, whitened string, n string")
    check(whitening.whitening_report(df).collect(), good, range(40))
    assert whitening.whitening_report(df.filter("vec_id >= 40 AND vec_id <> 45")).count() == 0
    assert whitening.whitening_report(df.filter("false")).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whitening.whitening_report(df).collect()
    assert len(rows) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(3, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = whitening.whitening_report(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate([1e12, -1e12, 1.0, 3.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitening_report(df).collect()}
    assert got[0] is None and got[1] is None and got[2] == (4 * 1024 - 4 * 1024) ** 2


@pytest.mark.parametrize("tile, direct", [(16, 16), (4, 2), (7, 7), (5, 64)])
def test_pair_sums_by_tiles(spark, tile, direct):
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (50, 18))
    df = spark.createDataFrame([([int(v) for v in row],) for row in x], "x array<long>")
    centre = [int(c) for c in x.sum(axis=0) // len(x)]
    want = (x - centre).T @ (x - centre)
    for kind in ("long", "double"):
        got = {(i, j): s for i, j, s in whitening.pair_sums(df, centre, kind, tile, direct)}
        assert got == {(i, j): want[i, j] for i in range(18) for j in range(i, 18)}
