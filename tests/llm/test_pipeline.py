"""The pipeline on the smallest tables: stages chain, keep clean documents and act on what they find."""

import pytest

from tests.conftest import SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from ledgerleaf.llm.staging import staged

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SMALL), name)
        out[name] = docs
    return out


def test_columns(stages):
    for name in ("quality", "near_duplicates", "repeated_passages", "secrets"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_drops_only_rejected(stages, spark):
    from ledgerleaf.llm.quality import quality_scores

    scores = {r.doc_id: r.predicted for r in quality_scores(stages["documents"], spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert {r.doc_id for r in stages["quality"].collect()} == {d for d, p in scores.items() if p == 1}


def test_near_duplicates_keep_one(stages):
    rows = stages["quality"].orderBy("doc_id").collect()
    sets = [brute.shingles(r.text) for r in rows]
    label = brute.components(len(rows), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == [rows[i].doc_id for i in sorted(set(label))]


def test_passages_and_secrets(stages):
    rows = stages["near_duplicates"].orderBy("doc_id").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute.repeats([r.text for r in rows]), strict=True)}
    after = {r.doc_id: r.text for r in stages["repeated_passages"].collect()}
    assert set(after) == {d for d, (n, gone, _) in want.items() if gone < n or n == 0}
    assert all(len(brute.words(t)) == want[d][0] - want[d][1] for d, t in after.items())
    clean = {r.doc_id: r for r in stages["secrets"].collect()}
    assert set(clean) == set(after) and all(not brute.base_secrets(r.text) and r.n_chars == len(r.text) for r in clean.values())


def test_packed(stages):
    ids = {r.doc_id for r in stages["secrets"].collect()}
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == ids
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
