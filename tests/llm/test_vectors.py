"""Operators on vectors against brute force."""

import numpy as np
import pytest
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, h1 string, n string, part string, width string"


def table():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    rows = [(i, base[i].tolist(), i % 3) for i in range(120)]
    rows += [(200 + i, (base[i % 7] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), (i % 7) % 3) for i in range(80)]
    rows += [(400 + i, base[5].tolist(), 2) for i in range(30)]
    rows += [(500, None, 1), (520, [0.0] * 16, 1), (540, [float("nan")] * 16, 1), (560, [1.0, None, *[0.0] * 14], 1), (580, base[1].tolist(), None), (600, base[2].tolist(), 2), (600, base[2].tolist(), 2), (None, base[3].tolist(), 0), (620, [1.0] * 8, 1), (640, [float("inf")] * 16, 0)]
    return rows


def vectors(rows):
    out = []
    for _, v, _ in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        out.append(np.array(v, float) if ok else None)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, *["c"] * 6) for r in table()], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("factor", [1.0, 0.2])
def test_embedding_dedup(frame, factor):
    from ledgerleaf.llm.pq_dedup import embedding_dedup

    rows, xs = table(), vectors(table())

    def linked(i, j):
        a, b = xs[i], xs[j]
        return i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93

    n = len(rows)
    label = brute.components(n, linked)
    low = {}
    for c, r in zip(label, rows, strict=True):
        low[c] = min((x for x in (low.get(c), r[0]) if x is not None), default=None)
    want = [(r[0], int(sum(linked(i, j) for j in range(n))), low[label[i]], r[0] is not None and r[0] == low[label[i]]) for i, r in enumerate(rows)]
    got = embedding_dedup(frame, 0.93, factor).collect()
    assert set(map(tuple, got)) ^ set(want) == set() and len(got) == len(want)


def test_embedding_dedup_of_nothing(spark):
    from ledgerleaf.llm.pq_dedup import embedding_dedup

    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    only = embedding_dedup(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 1, True), (2, 0, 2, True)]


def nearest(rows, k):
    xs, out = vectors(rows), []
    for q in sorted({r[0] for r in rows if r[0] is not None and r[0] % 20 == 0}):
        i = next(i for i, r in enumerate(rows) if r[0] == q)
        if xs[i] is None:
            continue
        found = sorted((-float((xs[j] * xs[i]).sum()), rows[j][0]) for j in range(len(rows)) if rows[j][0] not in (None, q) and xs[j] is not None and len(xs[j]) == len(xs[i]))[:k]
        out += [(q, n, v, -s) for n, (s, v) in enumerate(found, 1)]
    return out


def test_nearest_is_exact_at_factor_one(frame):
    from ledgerleaf.llm.vptree import nearest_neighbours

    got = sorted(map(tuple, nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), 20, shard=64, block=4).collect()))
    want = nearest(table(), 20)
    assert [(q, n, v) for q, n, v, _ in got] == [(q, n, v) for q, n, v, _ in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_smaller_factor_skips_more():
    from ledgerleaf.llm.vptree import Tree

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 6
    x = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    q = x[::97]
    exact = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    recall = {}
    for factor in (1.0, 0.95, 0.5, 0.1):
        some = Tree(x, 16).search(q, 10, factor)[0]
        recall[factor] = np.mean(np.sort(some, axis=1)[:, ::-1] >= exact - 1e-9)
    assert recall[1.0] == 1 and recall[1.0] >= recall[0.95] >= recall[0.5] >= recall[0.1] and recall[0.1] < 1


def test_nearest_of_nothing(spark, frame):
    from ledgerleaf.llm.vptree import nearest_neighbours

    none = spark.createDataFrame([], SCHEMA)
    assert nearest_neighbours(none, none).count() == 0
    assert nearest_neighbours(frame, none).count() == 0
    two = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours(two, two.where("vec_id = 20")).collect()] == [(20, 1, 3, 0.5)]


def test_ties_go_to_the_smaller_id(spark):
    """Hundreds of equal scores, and small integers with many ties at the end of each list, in one shard and in many."""
    from ledgerleaf.llm.vptree import nearest_neighbours

    rng = np.random.default_rng(2)
    flat = [(i, [1.0, float(i)], 0) for i in range(300)] + [(1000, [1.0, 0.0], 0)]
    signs = [(i, rng.choice([-1.0, 1.0], 6).tolist(), 0) for i in range(400)] + [(1000 + i, rng.integers(-2, 3, 6).astype(float).tolist(), 0) for i in range(200)]
    for rows, asked in ((flat, 1000), (signs, None)):
        df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>").repartition(3)
        for shard in (8192, 50):
            queries = df.where(f"vec_id = {asked}") if asked else df.where("vec_id % 20 = 0")
            got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(df, queries, 20, shard=shard).collect())
            want = nearest(rows, 20)
            assert got == sorted(w for w in want if asked is None or w[0] == asked)
    assert [w[2] for w in nearest(flat, 20) if w[0] == 1000] == list(range(20))


@pytest.mark.parametrize("factor", [1.0, 0.2])
def test_links_across_many_lists(spark, monkeypatch, factor):
    """Some 40 inverted lists: at factor 1 every link is found, at 0.2 nine tenths at least, and none below the threshold."""
    from ledgerleaf.llm import pq_dedup

    monkeypatch.setattr(pq_dedup, "PER_LIST", 50)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(500, 8)), 4, axis=0)
    x += 0.25 * rng.normal(size=x.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in pq_dedup.embedding_dedup(df, threshold=0.93, probe_factor=factor).collect()}
    found, want = np.array([got[i].n_links for i in range(len(x))]), near.sum(1)
    assert (found <= want).all() and found.sum() >= (1 if factor == 1 else 0.9) * want.sum() > 0
    if factor == 1:
        label = brute.components(len(x), lambda i, j: near[i, j])
        assert [got[i].component_id for i in range(len(x))] == list(label)
