"""Periodic runs against a search of every period."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import brute


def rows(rng):
    """Rows of few or many distinct words, with powers of roots written in, some roots powers themselves."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        w = [rng.randrange(rng.choice([1, 2, 3, 1000])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(4)):
            p = rng.randrange(1, 60)
            root = [rng.randrange(rng.choice([1, 2, 3, 1000])) for _ in range(p)]
            root = (root[: max(1, p // 3)] * 4)[:p] if rng.random() < 0.3 else root
            at = rng.randrange(len(w) + 1)
            w[at:at] = root * rng.randrange(2, 9) + root[: rng.randrange(p)]
        out.append(w)
    return out


@pytest.mark.parametrize("exponent,least", [(4, 6), (3, 5), (5, 6)])
def test_runs_are_those_of_brute_force(exponent, least):
    from ledgerleaf.llm.periodic import find_runs

    rng = random.Random(exponent)
    for _ in range(250):
        own = rows(rng)
        flat, first = np.array([x for r in own for x in r], np.int64), np.cumsum([0, *map(len, own)])
        got = list(zip(*[x.tolist() for x in find_runs(flat, first, exponent, least)], strict=True))
        assert got == [(i, *x) for i, r in enumerate(own) for x in brute.runs(r, exponent, least)]


TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a  a\na a a a"), (6, "x y x y x y x y x z z z z z z"), (None, "k " * 30), (7, "same text"), (7, "same text"), (8, "é ü " * 9 + "end"), (9, " ".join(f"w{i % 977}" for i in range(20_000)) + " tail"),
    (10, "a b c d e f g h i j k l " * 4), (11, "a b c d e f g h i j k l " * 3 + "a b c d e f g h i j k"), (12, "no run here at all"),
]


def test_edge_rows(spark):
    from ledgerleaf.llm.periodic import periodic_runs

    docs = spark.createDataFrame([(d, t, "c", "c", "c", "c") for d, t in TEXTS], "doc_id long, text string, id string, n_words string, runs string, collapsed string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)
    want = []
    for d, t in TEXTS:
        w = brute.words(t)
        found = brute.runs(w) if len(w) < 1000 else [(0, 20_000, 977)]
        want.append((d, len(w), found, brute.collapsed(w, found)))
    assert got == sorted(want, key=str)
    assert periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def test_query(spark):
    from ledgerleaf.llm import registry

    got = {r.doc_id: r for r in registry.op12_periodic_runs(spark, SMALL).collect()}
    n = 0
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        w = brute.planted(d.doc_id, d.text)
        if len(w) > 3000:
            continue
        found, r = brute.runs(w), got[d.doc_id]
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.n_words) == (len(found), *top, milli, len(w))
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (listed, brute.collapsed(w, found)))
        n += bool(found)
    assert n > 10 and len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_planting_of_edge_rows(spark):
    from ledgerleaf.llm.registry import _with_period

    rows = [(i, t) for i in [*range(60), None] for t in (None, "", " ", "one", "a b c d e f g h", "é  ü\tx y z " * 9)]
    got = [(r.doc_id, brute.words(r.text)) for r in _with_period(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(((d, brute.planted(d, t)) for d, t in rows), key=str)
