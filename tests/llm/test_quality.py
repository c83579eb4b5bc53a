"""Features against a plain count, weights against plain gradient descent on laid-out pairs, held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm import quality as q

TEXTS = ["The cat sat. THE cat!", "", " \n ", "a", "ab", "é中文 word", "x" * 300, "one\ttwo  three\n\nfour", "ab", None, "!!! ### 123"]


def plain_buckets(text):
    data = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    out = np.zeros(2 * q.BUCKETS)
    if not words:
        return out
    for i in range(len(low) - 2):
        h = int.from_bytes(low[i : i + 3], "big") * 0x9E3779B1 % 2**32
        out[((h ^ h >> 15) >> 7) % q.BUCKETS] += 1 / (len(low) - 2)
    for w, n in Counter(words).items():
        own = np.frombuffer(w, np.uint8)
        out[q.BUCKETS + int(bw.hash_spans(own, np.array([0]), np.array([len(w)]))[0]) % q.BUCKETS] += n / len(words)
    return np.sqrt(out)


def test_buckets_are_plain_counts():
    for texts in (TEXTS, TEXTS[::-1], [None, ""], ["ab", "c", "de f"], [t for t in TEXTS for _ in range(3)]):
        x = q.text_features(*bw.buffer(pa.array(texts, pa.string())))
        assert x.shape == (len(texts), q.FEATURES)
        np.testing.assert_allclose(x[:, q.FIGURES :], [plain_buckets(t) for t in texts], atol=1e-12)
        assert not x[[i for i, t in enumerate(texts) if not (t or "").strip()]].any()


def test_features_of_a_row_do_not_depend_on_its_neighbours():
    every = q.text_features(*bw.buffer(pa.array(TEXTS, pa.string())))
    for i, t in enumerate(TEXTS):
        np.testing.assert_allclose(q.text_features(*bw.buffer(pa.array([t], pa.string())))[0], every[i], atol=1e-12)


def test_weights_are_those_of_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=60) > 0).astype(int)
    better, worse = rng.choice(np.flatnonzero(y == 1), 500), rng.choice(np.flatnonzero(y == 0), 500)
    diff, w = x[better] - x[worse], np.zeros(7)
    for _ in range(20_000):
        w -= 0.2 * (diff.T @ (1 / (1 + np.exp(-diff @ w)) - 1) / 500 + 0.01 * w)
    np.testing.assert_allclose(q.bradley_terry(x, better, worse, 0.01), w, atol=1e-7)


def test_no_pairs_of_rows_that_differ():
    x = np.ones((4, 3))
    assert not q.bradley_terry(x, np.array([0, 1]), np.array([2, 3]), 0.1).any()


def test_words_alone_tell_labels_apart():
    """Two vocabularies of equally long words, in texts of equal length: no figure of the text tells them apart."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    y = np.arange(400) % 2
    texts = [" ".join(rng.choice(vocabulary[30 * k : 30 * k + 30], 40)) for k in y]
    x = q.text_features(*bw.buffer(pa.array(texts)))
    model = q.fit(x[:300], y[:300])
    assert np.mean((model.score(x[300:]) >= 0.7) == y[300:]) > 0.97


def trained_rows(docs, labels):
    """Features, as they are written, and labels of the documents to learn from."""
    own = [(t, labels[i]) for i, t in docs if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    return q.text_features(*bw.buffer(pa.array([t for t, _ in own]))).astype("<f4"), np.array([y for _, y in own])


def test_weights_are_those_of_all_pairs():
    """Every pair of a good and a bad row, laid out, gives the same weights; so do all rows twice, as the loss is a mean."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, q.FEATURES)) * np.where(np.arange(q.FEATURES) < q.FIGURES, 1, 0.2)
    y = (x[:, 0] + 4 * x[:, 40] + rng.normal(size=400) > -1).astype(int)
    model, good, bad = q.fit(x, y), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = q.bradley_terry(model.standard(x), np.repeat(good, len(bad)), np.tile(bad, len(good)), 1e-3)
    np.testing.assert_allclose(model.weights, w, atol=1e-9)
    ranked = np.sort(model.standard(x) @ w)
    assert abs(model.threshold - (ranked[len(bad) - 1] + ranked[len(bad)]) / 2) < 1e-8
    np.testing.assert_allclose(q.fit(np.tile(x, (2, 1)), np.tile(y, 2)).weights, w, atol=1e-9)


def test_scores_far_apart():
    """Bins of scores hundreds apart, and all rows of a label in one place."""
    rng = np.random.default_rng(12)
    for z in (rng.normal(size=60) * 150, np.repeat([-3.0, 2.0, 600.0], 20)):
        y = np.arange(60) % 2
        low = -400
        counts = np.zeros((2, 800, q.NODES))
        for v, c in zip(z, y, strict=True):
            place, share = q.shares(np.array([v]), q.NODES)
            counts[c, place[0] - low] += share[0]
        loss, own = q.sides(counts, low)
        u = z[y == 0][:, None] - z[y == 1]
        assert abs(loss - np.logaddexp(0, u).mean()) < 1e-10 * max(1, loss)
        slope = {0: q.logistic(u).sum(axis=1), 1: -q.logistic(u).sum(axis=0)}
        for label in (0, 1):
            place, share = q.shares(z[y == label], q.NODES)
            np.testing.assert_allclose((share * own[label].slope[place - own[label].low]).sum(axis=1), slope[label] / u.size, atol=1e-12)


def test_train_learns_from_all_pairs_of_all_rows(spark):
    rng = np.random.default_rng(13)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(80)]
    labels = {i: int(rng.random() < 0.7) for i in range(0, 600, 2)}
    docs = [(i, " ".join(rng.choice(vocabulary[20 * labels.get(i, 0) : 20 * labels.get(i, 0) + 50], 30))) for i in range(600)]
    docs += docs[:40]  # repeated rows count as often as they are there
    model = q.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    x, y = trained_rows(docs, labels)
    np.testing.assert_allclose(model.mean, x.astype(float).mean(axis=0), atol=1e-9)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    np.testing.assert_allclose(model.weights, q.bradley_terry(model.standard(x), np.repeat(good, len(bad)), np.tile(bad, len(good)), 1e-3), atol=1e-8)
    ranked = np.sort(model.raw(x))
    assert abs(model.threshold - (ranked[len(bad) - 1] + ranked[len(bad)]) / 2) < 1e-9


def test_train_reads_more_rows_than_a_sample_held(spark):
    """30,000 labelled rows: each counts in the model."""
    docs = [(i, f"{'good' if i % 3 else 'bad'} {i % 997} x{i % 7}") for i in range(30_000)]
    labels = {i: int(i % 3 > 0 or i % 11 == 0) for i, _ in docs}
    model = q.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    x, y = trained_rows(docs, labels)
    assert len(x) > 20_000
    np.testing.assert_allclose(model.mean, x.astype(float).mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(model.weights, q.fit(x, y).weights, atol=1e-8)
    ranked = np.sort(model.raw(x))
    assert abs(model.threshold - (ranked[(y == 0).sum() - 1] + ranked[(y == 0).sum()]) / 2) < 1e-9


def test_value_at_every_rank(spark):
    z = [0.0, -1e300, 5.0, 5.0, 5.0, 5.000000000000001, 7e-320, -0.5, 1e300, *np.random.default_rng(14).normal(size=300).tolist()]
    df = spark.createDataFrame([(v,) for v in z], "z double").repartition(3)
    ranked = sorted(z)
    for rank in (0, 1, 2, 150, 170, len(z) - 5, len(z) - 4, len(z) - 3, len(z) - 2, len(z) - 1):
        assert q.value_at(df, rank) == ranked[rank]
    assert q.value_at(df.where("z = 5"), 2) == 5.0
