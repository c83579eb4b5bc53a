"""Whitening against eigenvectors of the covariance, and the solver against dense algebra."""

import numpy as np
import pytest

from tests.conftest import SMALL


def symmetric(rng, values):
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = (turn * values) @ turn.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 9, 64), np.r_[5, 4, 3, np.zeros(40)], np.r_[np.full(20, 5.0), np.ones(80)], np.linspace(1, 2, 8), np.ones(1), 1 / np.arange(1, 401)], ids=["even", "low rank", "equal", "small", "one", "wide"])
def test_pairs_reach_double_precision(values):
    from ledgerleaf.llm.whitening import jacobi_davidson

    a = symmetric(np.random.default_rng(1), values)
    e, u, r = jacobi_davidson(lambda x: a @ x, len(a), 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    assert len(e) == min(16, len(a)) and np.abs(e - want).max() < 1e-13 * want[0]
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 5e-14 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and r.max() < 5e-14 * want[0]


def test_minres():
    from ledgerleaf.llm.whitening import minres

    rng = np.random.default_rng(2)
    a, b = symmetric(rng, np.r_[np.linspace(-4, -1, 10), np.linspace(1, 6, 20)]), rng.normal(size=(30, 3))
    calls = []
    x = minres(lambda v: calls.append(1) or a @ v, b, 60, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-10 and len(calls) <= 35
    assert not minres(lambda v: a @ v, np.zeros((30, 2)), 5, 1e-12).any()


def expected(rows, k=16):
    """{row number: (deviation, whitened up to sign)} and (n, explained), by dense algebra."""
    x = [np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for v in rows]
    fit = np.unique(np.array(x), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    white = [((n * r - s) / n) @ u[:, :k] / np.sqrt(e[:k]) for r in x]
    return n, [sum(int(d) ** 2 for d in n * r - s) for r in x], white, e[:k] / e.sum()


def compare(got, ids, rows):
    n, deviation, white, explained = expected(rows)
    k = len(explained)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    sign = np.sign([by[ids[0], i + 1].whitened * white[0][i] for i in range(k)])
    for at, vec in enumerate(ids):
        mine = [by[vec, i + 1] for i in range(k)]
        assert {r.deviation for r in mine} == {deviation[at]}
        assert np.allclose([r.whitened for r in mine] * sign, white[at], atol=1e-8) and np.allclose([r.explained for r in mine], explained, rtol=1e-10)
    assert {r.identity_error < 1e-9 for r in got} == {True} and len({r.identity_error for r in got}) == 1 and max(r.residual for r in got) < 5e-14


def test_query(spark):
    from ledgerleaf.llm import registry

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    compare(registry.op13_embedding_whitening(spark, SMALL).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_edge_rows(spark):
    from ledgerleaf.llm.whitening import whiten

    rng = np.random.default_rng(3)
    wide, low = rng.normal(size=(40, 5)), np.round(rng.normal(size=(20, 2)) * 64) / 64 @ np.array([[1, 0, 0, 2], [0, 1, 0, 0]])
    good = [(i, v.tolist()) for i, v in enumerate(wide)] + [(40, wide[3].tolist())]
    low = [(100 + i, v.tolist()) for i, v in enumerate(low)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "c", "c", "c") for i, v in good + low + bad], "vec_id long, embedding array<double>, x string, component string, n string").repartition(3)
    got = whiten(df).collect()
    compare([r for r in got if r.vec_id < 100], [i for i, _ in good], [v for _, v in good])
    second = [r for r in got if r.vec_id >= 100]
    assert {r.component for r in second} == {1, 2} and {r.vec_id for r in second} == {i for i, _ in low}
    compare(second, [i for i, _ in low], [v for _, v in low])
    assert whiten(df.where("false")).count() == 0
    far = spark.createDataFrame([(None, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whiten(far).collect()} == {(None, None), (2, None), (3, expected([[0.0, 5.0], [2.0**34, 1.0], [-(2.0**34), 2.0]])[1][0])}
