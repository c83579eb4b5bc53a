"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest

from tests.conftest import SMALL
from tests.llm import brute

NAMES = ["score", "kept_id", "kept", "text_hash", "spans", "key", "row", "held_out", "predicted", "label_id", "id", "h", "n", "piece", "row_key", "component_id", "_text", "_row", "first", "fill", "start"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
FILTERS = ["quality", "near_duplicates", "repeated_passages", "secrets"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def stage(spark, name, rows):
    import corpus_pipeline
    from ledgerleaf.llm.staging import staged

    docs = spark.createDataFrame([(d, t, lang, "web", n, *["c"] * len(NAMES)) for d, t, lang, n in rows], SCHEMA).repartition(3)
    out = staged(dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL), name)
    assert name == "packing" or out.schema == docs.schema
    return out.collect()


def texts(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


@pytest.mark.parametrize("name", [*FILTERS, "packing"])
def test_empty_table(spark, name):
    assert stage(spark, name, []) == []


@pytest.mark.parametrize("name", FILTERS)
def test_nulls_in_any_column_and_clashing_names(spark, name):
    """Rows with nulls pass through whole, with all their columns; near-dedup keeps one of the wordless ones."""
    rows = [(1, None, None, None), (2, "", None, 0), (3, " \n ", "en", 3), (None, prose(1, 30), None, None), (5, prose(2, 30), "en", 7)]
    got = stage(spark, name, rows)
    if name == "quality":
        assert {r.text in (None, "", " \n ") for r in got} <= {True, False} and len({r.doc_id in (1, 2, 3) for r in got if r.text in (None, "", " \n ")}) <= 1
        assert len([r for r in got if r.text in (None, "", " \n ")]) in (0, 3)
        return
    want = [r for r in rows if name != "near_duplicates" or r[0] not in (2, 3)]
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(repr((d, t, lang, "web", n)) for d, t, lang, n in want)
    assert all(tuple(r)[5:] == ("c",) * len(NAMES) for r in got)


def test_packing_of_edge_rows(spark):
    rows = [(1, None, None, None), (2, "", None, 0), (None, "one two", None, None), (4, prose(4, 3000), "en", 1), (4, prose(4, 3000), "en", 1)]
    got = stage(spark, "packing", rows)
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.piece == 0) == [(False, 1), (False, 2), (False, 4), (False, 4), (True, None)]
    assert sum(r.length for r in got if r.doc_id == 4) % 2 == 0 and {r.length for r in got if r.doc_id in (1, 2)} == {1}
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("name", FILTERS)
def test_very_long_text(spark, name):
    long = prose(7, 300_000)
    got = texts(stage(spark, name, [(1, long, "en", len(long)), (2, "token=abcdefgh12 " + prose(8, 20), "en", 1)]))
    assert (1, long) in got or name == "quality"
    assert name != "secrets" or got[1][1] == "[SECRET] " + prose(8, 20)


def test_repeated_rows_and_ties(spark):
    """Equal texts stand or fall together in quality; one stays in near-dedup, the smallest id first; each loses its words in passages; each is redacted."""
    a, b = prose(1, 60), prose(2, 60) + " api_key: abcdef123456"
    rows = [(3, a, "en", 1), (3, a, "en", 1), (2, a, "en", 1), (None, a, "en", 1), (9, b, "en", 1), (9, b, "en", 1)]
    assert len(stage(spark, "quality", rows)) in (0, 2, 4, 6)
    assert texts(stage(spark, "near_duplicates", rows)) == [(2, a), (9, b)]
    assert stage(spark, "repeated_passages", rows) == []
    assert texts(stage(spark, "secrets", rows)) == sorted([(d, t.replace("api_key: abcdef123456", "[SECRET]")) for d, t, _, _ in rows], key=repr)


def test_passages_of_rows_that_share_an_id(spark):
    shared, a, b = prose(1, 40), prose(2, 10), prose(3, 10)
    got = texts(stage(spark, "repeated_passages", [(1, f"{a} {shared}", "en", 1), (1, f"{shared} {b}", "en", 1), (None, prose(4, 50), "en", 1)]))
    assert got == sorted([(1, a), (1, b), (None, prose(4, 50))], key=repr) and brute.words(a)[0]
