"""Benchmark decontamination against brute force, in segments and blocks of every size."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import brute

RNG = random.Random(4)
VOCAB = ["the", "The", "a", "ß", "42", "été", "x1", "of", "rare"]


def made(n, vocab=VOCAB):
    return RNG.choice([" ", "-", "\n", ", "]).join(RNG.choice(vocab) for _ in range(n))


ITEM = [f"q{i}" for i in range(24)]
ITEMS = [
    (1, " ".join(ITEM)), (2, "one"), (3, "The, of!"), (10, " ".join(ITEM[5:20]).upper()), (4, None), (5, ""), (6, " .. "), (7, made(12)), (7, made(11)), (None, "secret words " + " ".join(f"z{i}" for i in range(9))),
    (8, "a a a a a a a a a a a a"), (9, made(300)), (1, " ".join(ITEM)),
]
DOCS = [
    (1, "before " + " ".join(ITEM) + " after"), (2, None), (3, ""), (4, " \t- "), (5, "One"), (6, "of the, of a"), (7, made(500)), (None, " ".join(ITEM[3:14])), (None, None), (8, "x " + "a " * 40), (8, "x " + "a " * 40),
    (9, " ".join(ITEM[:9])), (10, " ".join([*ITEM[:5], "extra", *ITEM[5:12]])), (11, " ".join(ITEM[12:20]) + " "), (12, "q20 q21 q22 q23"), (13, made(4000, ["the", "of", "a"])), (14, ITEMS[9 + 2][1] + " tail"), (15, "secret words " + " ".join(f"z{i}" for i in range(9))),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "c", "c", "c", "c") for d, t in DOCS], "doc_id long, text string, segment string, doc string, items string, window string").repartition(3)
    items = spark.createDataFrame([(i, t, "c", "c") for i, t in ITEMS], "item_id long, text string, words string, block string").repartition(2)
    return docs, items


@pytest.mark.parametrize("segment,block,most", [(4 << 20, 10_000, 32 << 20), (300, 7, 32 << 20), (300, 50, 0)])
def test_phrases_are_those_of_brute_force(tables, segment, block, most):
    from ledgerleaf.llm.decontamination import decontaminate

    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated, sum(s.end - s.start for s in r.spans)) for r in decontaminate(*tables, segment=segment, block=block, most=most).collect()), key=str)
    want = [(d, n, hit, items, hit > 0, hit) for (d, _), (n, hit, items) in zip(DOCS, brute.leaks([t for _, t in DOCS], ITEMS), strict=True)]
    assert got == sorted(want, key=str) and sum(w[4] for w in want) > 6


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity_matches_are_those_of_brute_force(tables, slack):
    from ledgerleaf.llm.decontamination import decontaminate

    texts = [(d, t) for d, t in DOCS if d is not None and len(t or "") < 4000]
    docs = tables[0].where("doc_id is not null and coalesce(length(text), 0) < 4000")
    got = sorted(((r.doc_id, r.n_hit, [tuple(x) for x in r.near]) for r in decontaminate(docs, tables[1], window=6, slack=slack, segment=500).collect()), key=str)
    want = [(d, hit, brute.near_ranges(t, ITEMS, 6, slack)) for (d, t), (_, hit, _) in zip(texts, brute.leaks([t for _, t in texts], ITEMS, 6), strict=True)]
    assert got == sorted(want, key=str) and any(n and d == 10 for d, _, n in want)


def test_parts_of_candidates_and_numbers():
    from ledgerleaf.llm import decontamination as dc

    values = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 21) - 1, 1 << 40])
    data, size = dc.packed(values)
    assert dc.unpacked(data).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 3, 6]
    s = {"counts": np.array([5, 3], np.uint32)}
    data, size = dc.packed(np.array([0, 1, 1, 1, 1, 4, 2, 1]))
    s |= {"places": data, "sizes": np.array([5, 3], np.uint32)}
    for part in (1, 2, 100):
        got = [(int(w), int(a)) for x in dc.search(s, [np.array([0, 0]), np.array([0, 1]), np.array([1])], candidates=part) for w, a in zip(x[0], x[1], strict=True)]
        assert sorted(got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 4), (2, 6), (2, 7)]


def test_empty_tables(spark, tables):
    from ledgerleaf.llm.decontamination import decontaminate

    docs, items = tables
    assert decontaminate(docs.where("false"), items).count() == 0
    assert {(r.n_hit, len(r.items), r.contaminated) for r in decontaminate(docs, items.where("false"), slack=1).collect()} == {(0, 0, False)}


def test_query(spark):
    from ledgerleaf.llm import registry

    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in registry.op11_benchmark_decontamination(spark, SMALL).collect()}
    found = brute.leaks([r.text for r in docs], [(r.item_id, r.text) for r in items])
    assert got == {r.doc_id: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for r, (n, h, i) in zip(docs, found, strict=True)}
    assert any(x[4] for x in got.values())
