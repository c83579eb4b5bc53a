"""Stages of the pipeline on hand-written rows."""

import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], SCHEMA).repartition(3)


def test_one_whole_copy_of_repeated_rows_and_null_ids(spark):
    import corpus_pipeline as p
    from ledgerleaf.llm.staging import staged

    a, b, c, d = (" ".join(prose(i, 60)) for i in range(4))
    near = a.replace(a.split()[0], "changed", 1)
    rows = [(1, a), (1, a), (1, near), (None, a), (None, b), (None, b), (3, c), (None, c), (4, d)]
    once = staged(p.near_duplicates(spark, frame(spark, rows), ""), "once")
    got = sorted(((r.doc_id, r.text) for r in once.collect()), key=str)
    assert len(got) == 4 and {x for x in got if x[0] != 1} == {(None, b), (3, c), (4, d)}
    assert {x[1] for x in got if x[0] == 1} <= {a, near}
    assert sorted(((r.doc_id, r.text) for r in p.repeated_passages(spark, once, "").collect()), key=str) == got


def edited():
    """Texts of 3 to 400 words, copies of them with some words changed, a large cluster of one text's copies and a few oddities."""
    rng, out = random.Random(8), []
    for n in [3, 4, 5, 6, 12, 40, 90, 200, 400] * 3:
        base = prose(rng.random(), n)
        out.append(" ".join(base))
        for rate in (0.002, 0.01, 0.02, 0.03, 0.04, 0.06):
            out.append(" ".join("x" + w if rng.random() < rate else w for w in base))
    base = prose(1, 80)
    out += [" ".join("x" + w if rng.random() < 0.02 else w for w in base) for _ in range(60)]
    chain = prose(2, 100)
    for i in range(12):
        chain[7 * i] = f"step{i}"
        out.append(" ".join(chain))
    return [*out, "", "  \n", None, "Upper CASE words Are Equal here", "upper case words are equal HERE"]


@pytest.mark.parametrize("block", [4096, 8])
def test_near_copies_are_those_of_brute_force(spark, block):
    from ledgerleaf.llm.near_copies import near_copies

    texts = edited()
    sets = [brute.shingles(t) for t in texts]
    label = brute.components(len(texts), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(3)
    assert {r.n: r.component_id for r in near_copies(rows, "n", block=block).collect()} == dict(enumerate(label))
    assert near_copies(rows.where("n < 0"), "n").count() == 0


def test_near_duplicates_decide_by_shared_shingles(spark):
    """Documents 1 and 177 share 0.83 of their shingles at 17 bits of distance, 155 and 192 share 0.76 at four."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id in (1, 177, 155, 192)")
    assert sorted(r.doc_id for r in p.near_duplicates(spark, docs, SMALL).collect()) == [1, 155, 192]


def test_a_group_of_any_size_meets_two_blocks_at_a_time(spark):
    """300 texts of one group, each a part of its own but for ten, in tasks of some 8: all met in one task before."""
    from ledgerleaf.llm.near_copies import crossing

    size = [5 + (i * 37) % 200 for i in range(300)]
    part = [0 if i < 10 else i for i in range(300)]
    rows = spark.createDataFrame([(i, 0, part[i], size[i], 10) for i in range(300)], "node long, meeting long, part long, size long, bytes long")
    tasks = {}
    for r in crossing(rows, 0.8, 8).collect():
        tasks.setdefault(r.one, set()).add(r.node)
    assert max(map(len, tasks.values())) < 30
    met = {(a, b) for nodes in tasks.values() for a in nodes for b in nodes}
    assert all((a, b) in met for a in range(300) for b in range(a) if part[a] != part[b] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]))


def test_groups_are_dealt_by_bytes_too(spark):
    """Forty texts of 1 MB with three shingles each are no block."""
    from ledgerleaf.llm.near_copies import BYTES, blocks

    rows = spark.range(40).selectExpr("id as node", "3L as size", "1L << 20 as bytes")
    assert rows.agg(blocks(4096).alias("n")).first().n == 40 * (1 << 20) // BYTES
    assert spark.range(2).selectExpr("3L as size", "1L << 30 as bytes").agg(blocks(4096).alias("n")).first().n == 2


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_rows_are_those_of_all_pairs(threshold):
    from ledgerleaf.llm.near_copies import similar

    rng = np.random.default_rng(7)
    for turn in range(60):
        pool = rng.integers(0, 60, 30).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(pool, rng.integers(0, 20)), rng.integers(0, 200, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(rng.integers(1, 25))]
        known = rng.integers(0, len(sets), len(sets)) if turn % 2 else np.arange(len(sets))
        first = np.append(0, np.cumsum([len(x) for x in sets]))
        links = list(zip(*(x.tolist() for x in similar(np.concatenate(sets), first, threshold, known)), strict=True))
        alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= threshold * max(1, len(np.union1d(sets[i], sets[j])))  # noqa: B023, E731
        same = lambda i, j: known[i] == known[j] and len(sets[i]) > 0 and len(sets[j]) > 0  # noqa: B023, E731
        assert all(alike(i, j) for i, j in links)
        got = brute.components(len(sets), lambda i, j: same(i, j) or (i, j) in links or (j, i) in links)  # noqa: B023
        assert got.tolist() == brute.components(len(sets), lambda i, j: same(i, j) or alike(i, j)).tolist()  # noqa: B023
