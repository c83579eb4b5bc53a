"""Embedding dedup where vectors have several lengths."""

import numpy as np


def test_embedding_dedup_searches_every_length(spark):
    from ledgerleaf.llm.pq_dedup import embedding_dedup

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(450)]
    rows += [(1000 + i, rng.normal(size=12).tolist()) for i in range(450)]
    for at, base in ((500, 7), (1500, 460)):  # near copies at both common lengths
        rows.append((at, (np.array(rows[base][1]) * (1 + 1e-3 * rng.normal(size=len(rows[base][1])))).tolist()))
    short = rng.normal(size=8)
    rows += [(2000, short.tolist()), (2001, (2 * short + 0.01).tolist()), (3000, rng.normal(size=300).tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, 0.99).collect()}
    want = {i: (0, i) for i, _ in rows} | {7: (1, 7), 500: (1, 7), 1010: (1, 1010), 1500: (1, 1010), 2000: (1, 2000), 2001: (1, 2000)}
    assert got == want
