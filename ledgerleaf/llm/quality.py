"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Each pair is a row labelled 1 and a row labelled 0. The chance that the first
is preferred is the logistic of the difference of their scores, which are
linear in features of the text; weights minimise the logistic loss on feature
differences, its mean over all pairs of all labelled rows. The threshold is
the quantile of the training scores at the share of rows labelled 0, placed
at ``accept`` on the scale from 0 to 1.

No pair is ever laid out. The loss and its derivatives ask of a row only what
a smooth function sums to over the scores of the other label. Scores fall in
bins; a polynomial through a bin's Chebyshev nodes gives the function in the
bin, so a score is as good as its shares of the nodes. Shares add up over the
rows in a pass, and the sums of all pairs are those of pairs of nodes. Each
step of Newton's method is two passes over the features of the labelled rows,
which are written once; partial sums meet in a shuffle, so neither the driver
nor a task holds more than sums whose size is that of the features squared.

Features are figures of the whole text (byte classes, kinds of words, lengths,
repetition) and, hashed into buckets, its words and runs of three bytes, A-Z
lower-cased: the square root of each bucket's share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.staging import drop, staged

#: Makes an array of some rows' features and labels.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: The sum over all rows of such an array, entry by entry; empty if there are no rows.
Total = Callable[[Part], np.ndarray]
#: Byte classes whose share of a text is a feature.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!", "#$%&*", "@^~<>{}[]\\=+_", ".,;:?'\"-()", "\n"]
#: Figures of the text, buckets of three-byte runs and as many of words, all features.
FIGURES, BUCKETS = 15, 256
FEATURES = FIGURES + 2 * BUCKETS
#: Texts whose features are held at once.
ROWS = 2000
#: Width of a bin of scores, and its nodes: the logistic is told to 1e-12 by ``NODES``, and to 1e-4 by ``COARSE``, which only speed depends on.
WIDTH, NODES, COARSE = 2.0, 16, 6
#: Entries of a sum that travel as one row.
CHUNK = 16_384
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES): ``figures`` and ``buckets`` of each text; zeros for a text without words."""
    words = bw.words(data, offsets)
    return np.concatenate([figures(data, offsets, *words), buckets(data, offsets, *words)], axis=1)


def buckets(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 2 * BUCKETS): square roots of the shares of hashed three-byte runs and of hashed words, A-Z lower-cased."""
    n, count, size = len(offsets) - 1, np.diff(first), np.diff(offsets)
    out = np.zeros((n, 2 * BUCKETS))
    if not len(start):
        return out
    low = bw.LOWER[data]
    if len(low) > 2:
        key = run_buckets(low) + np.repeat(np.arange(n) * BUCKETS, size)[:-2]
        ends = offsets[1:][size > 0]
        across = np.concatenate([ends - 2, ends - 1])  # runs that begin here leave their text
        key[across[(across >= 0) & (across < len(key))]] = n * BUCKETS
        out[:, :BUCKETS] = np.bincount(key, minlength=n * BUCKETS + 1)[:-1].reshape(n, BUCKETS) / np.maximum(size - 2, 1)[:, None]
    word = (bw.hash_spans(low, start, end) % np.uint64(BUCKETS)).astype(np.int64)
    out[:, BUCKETS:] = np.bincount(np.repeat(np.arange(n) * BUCKETS, count) + word, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(count, 1)[:, None]
    return np.sqrt(out) * (count > 0)[:, None]


def run_buckets(low: np.ndarray) -> np.ndarray:
    """The bucket of each three bytes in a row."""
    x = low.astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    h *= np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) >> np.uint32(7)).astype(np.int64) % BUCKETS


def figures(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, FIGURES): shares of byte classes and of word kinds, word length, length and repetition; zeros for no words."""
    n = len(offsets) - 1
    count, size = np.diff(first), np.diff(offsets)
    safe = np.maximum(count, 1)
    row = np.repeat(np.arange(n), count)
    out = np.zeros((n, FIGURES))
    if not len(start):
        return out
    kinds = np.bincount(np.repeat(np.arange(n), size) * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, : len(CLASSES)]
    out[:, :8] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    per_row = lambda flag: np.sqrt(np.bincount(row, flag, minlength=n) / safe)
    letters, upper = np.cumsum(np.append(0, _LETTER[data])), np.cumsum(np.append(0, _UPPER[data]))
    own, caps = letters[end] - letters[start], upper[end] - upper[start]
    out[:, 8] = per_row((caps == own) & (own > 1))
    out[:, 9] = per_row(own == 0)
    out[:, 10] = per_row(np.isin(_CLASS[data[end - 1]], [3, 4, 5]))
    out[:, 11] = np.log1p(np.bincount(row, end - start, minlength=n) / safe)
    out[:, 12] = np.log1p(count)
    word = bw.hash_spans(data, start, end)
    key = bw.mix(word + row.astype(np.uint64) * bw.MULTIPLIER)
    _, at = np.unique(key, return_index=True)
    out[:, 13] = np.bincount(row[at], minlength=n) / safe
    pairs = np.flatnonzero(np.diff(row) == 0)
    two = bw.mix(key[pairs] + bw.MULTIPLIER * word[pairs + 1])
    _, at = np.unique(two, return_index=True)
    out[:, 14] = np.bincount(row[pairs[at]], minlength=n) / np.maximum(np.bincount(row[pairs], minlength=n), 1)
    return out * (count > 0)[:, None]


@dataclass(frozen=True)
class Ranker:
    """Weights on standardised features, and the score that maps to ``accept``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    accept: float

    def standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6)

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.standard(features) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.raw(features) - self.threshold + math.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float) -> np.ndarray:
    """Weights that minimise the mean logistic loss of x[better] over x[worse], plus half of ``penalty`` times their squares: for given pairs of rows in memory."""
    n, pairs, w = len(x), len(better), np.zeros(x.shape[1])
    back = lambda r: x.T @ (np.bincount(better, r, minlength=n) - np.bincount(worse, r, minlength=n)) / pairs
    for _ in range(50):
        z = x @ w
        p = 1 / (1 + np.exp(-np.clip(z[better] - z[worse], -40, 40)))
        gradient, curve = back(p - 1) + penalty * w, p * (1 - p)
        step, rest, way = np.zeros_like(w), gradient.copy(), gradient.copy()
        left = first = float(rest @ rest)
        for _ in range(4 * len(w)):
            if left <= 1e-18 * first or left == 0:
                break
            u = x @ way
            turned = back(curve * (u[better] - u[worse])) + penalty * way
            size = left / float(way @ turned)
            step += size * way
            rest -= size * turned
            left, before = float(rest @ rest), left
            way = rest + left / before * way
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def shares(z: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each score, its shares of the bin's ``p`` Chebyshev nodes): a smooth f has f(z) = sum of shares times f at the nodes."""
    place = np.floor(z / WIDTH)
    k = np.arange(p)
    base = np.cos(np.outer(k, math.pi * (k + 0.5) / p)) * 2 / p
    base[0] /= 2
    return place.astype(np.int64), np.polynomial.chebyshev.chebvander(2 * (z / WIDTH - place) - 1, p - 1) @ base


def nodes(low: int, high: int, p: int) -> np.ndarray:
    """The scores of the nodes of the bins ``low`` to ``high``, a row for each bin."""
    return WIDTH * (np.arange(low, high + 1)[:, None] + (1 + np.cos(math.pi * (np.arange(p) + 0.5) / p)) / 2)


def logistic(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -700, 700)))


@dataclass(frozen=True)
class Side:
    """The rows of one label: their bins, and at the bins' nodes the mean slope and curvature of the pairs that a score there is in."""

    low: int
    high: int
    slope: np.ndarray
    curve: np.ndarray


def sides(counts: np.ndarray, low: int) -> tuple[float, list[Side]]:
    """(mean loss of all pairs, the rows labelled 0 and those labelled 1) from (2, bins, NODES) sums of shares, bins from ``low``."""
    pairs = counts[0].sum() * counts[1].sum()
    found = [np.flatnonzero(c.any(axis=1)) for c in counts]
    spans = [(low + int(f[0]), low + int(f[-1])) for f in found]
    of = [c[f[0] : f[-1] + 1].ravel() for c, f in zip(counts, found, strict=True)]
    at = [nodes(*span, NODES).ravel() for span in spans]
    loss = float(of[1] @ (np.logaddexp(0, at[0] - at[1][:, None]) @ of[0]) / pairs)
    out = []
    for y, (first, last) in enumerate(spans):
        sign = 1 if y == 0 else -1  # a higher score of a row labelled 0 adds to the loss
        own = nodes(first - 1, last + 1, NODES)  # a bin more each way, for scores that rounding moves
        p = logistic(sign * (own.reshape(-1, 1) - at[1 - y]))
        out.append(Side(first - 1, last + 1, (sign * p @ of[1 - y] / pairs).reshape(own.shape), ((p * (1 - p)) @ of[1 - y] / pairs).reshape(own.shape)))
    return loss, out


def score_counts(total: Total, standard: Callable[[np.ndarray], np.ndarray], w: np.ndarray) -> tuple[np.ndarray, int]:
    """((2, bins, NODES) sums of the shares of the scores of each label, number of the first bin)."""
    low = -int(6 * np.abs(w).sum() / WIDTH) - 2  # standardised features are within 6
    bins = -2 * low

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place, share = shares(standard(x) @ w, NODES)
        index = ((y * bins + place - low) * NODES)[:, None] + np.arange(NODES)
        return np.bincount(index.ravel(), share.ravel(), minlength=2 * bins * NODES)

    return total(part).reshape(2, bins, NODES), low


def derivatives(total: Total, standard: Callable[[np.ndarray], np.ndarray], w: np.ndarray, own: list[Side], pairs: float) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, matrix of second derivatives) of the mean loss of all pairs.

    The gradient is to double precision. The matrix is the sum of each row's
    own square, weighed by its curvature, less the products across labels,
    which go through the coarse nodes; single precision is enough for it.
    """
    d = len(w)
    upper = np.triu_indices(d)
    sizes = [(s.high - s.low + 1) * COARSE for s in own]

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = standard(x)
        z, single = x @ w, x.astype(np.float32)
        slope, curve, across = np.zeros(len(x)), np.zeros(len(x)), []
        for label, side in enumerate(own):
            mine = np.flatnonzero(y == label)
            place, share = shares(z[mine], NODES)
            slope[mine] = (share * side.slope[place - side.low]).sum(axis=1)
            curve[mine] = (share * side.curve[place - side.low]).sum(axis=1)
            place, share = shares(z[mine], COARSE)
            spread = np.zeros((len(mine), sizes[label]), np.float32)
            np.put_along_axis(spread, ((place - side.low) * COARSE)[:, None] + np.arange(COARSE), share.astype(np.float32), axis=1)
            across.append((spread.T @ single[mine]).ravel())
        weighed = single * np.sqrt(np.maximum(curve, 0)).astype(np.float32)[:, None]
        return np.concatenate([slope @ x, (weighed.T @ weighed)[upper], *across])

    slope, squares, bad, good = np.split(total(part), np.cumsum([d, len(upper[0]), sizes[0] * d]))
    matrix = np.zeros((d, d))
    matrix[upper] = squares
    matrix += np.triu(matrix, 1).T
    at = [nodes(s.low, s.high, COARSE).ravel() for s in own]
    p = logistic(at[0] - at[1][:, None])
    cross = good.reshape(-1, d).T @ (p * (1 - p) / pairs) @ bad.reshape(-1, d)
    return slope, matrix - cross - cross.T


def all_pairs(total: Total, standard: Callable[[np.ndarray], np.ndarray], d: int, pairs: float, penalty: float) -> np.ndarray:
    """Weights that minimise the mean logistic loss of all ``pairs`` of a row labelled 1 over one labelled 0, plus half of ``penalty`` times their squares.

    Newton's method from zero; a step that does not lower the loss is halved.
    """
    w, step, best = np.zeros(d), np.zeros(d), math.inf
    for _ in range(100):
        loss, own = sides(*score_counts(total, standard, w + step))
        loss += penalty / 2 * float(np.square(w + step).sum())
        if loss > best + 1e-11:
            step = step / 2
            continue
        w, best = w + step, loss
        slope, matrix = derivatives(total, standard, w, own, pairs)
        step = np.linalg.solve(matrix + penalty * np.eye(d), -slope - penalty * w)
        if np.abs(step).max() < 1e-6:
            return w + step
    return w


def standardised(total: Total) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of rows labelled 0 and 1, mean, scale): figures have their deviation as scale, the shares of buckets are centred and keep one scale."""
    scale = np.full(FEATURES, 4 / math.sqrt(BUCKETS))
    sums = total(lambda x, y: np.concatenate([np.bincount(y, minlength=2), x.sum(axis=0, dtype=np.float64)]))
    if not len(sums):
        return np.zeros(2), np.zeros(FEATURES), np.ones(FEATURES)
    n, mean = sums[:2].sum(), sums[2:] / sums[:2].sum()
    scale[:FIGURES] = np.sqrt(total(lambda x, y: np.square(x[:, :FIGURES] - mean[:FIGURES]).sum(axis=0)) / n) + 1e-9
    return sums[:2], mean, scale


def learnt(total: Total, middle: Callable[[Ranker, int], float], accept: float, penalty: float) -> Ranker:
    """A ranker from all rows that ``total`` sums over. One class only: every text is accepted.

    ``middle`` tells the score half way between the last of the so many lowest and the next one.
    """
    (bad, good), mean, scale = standardised(total)
    plain = Ranker(mean, scale, np.zeros(FEATURES), 0.0, accept)
    if not bad or not good:
        return plain
    model = replace(plain, weights=all_pairs(total, plain.standard, FEATURES, bad * good, penalty))
    return replace(model, threshold=middle(model, int(bad)))


def fit(features: np.ndarray, labels: np.ndarray, accept: float = 0.7, penalty: float = 1e-3) -> Ranker:
    """``learnt`` from rows in memory."""

    def middle(model: Ranker, cut: int) -> float:
        ranked = np.sort(model.raw(features))
        return float((ranked[cut - 1] + ranked[cut]) / 2)

    return learnt(lambda part: part(features, labels) if len(features) else np.zeros(0), middle, accept, penalty)


def held_out(id_col: str, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def features(rows: DataFrame, text_col: str) -> DataFrame:
    """(y, x): the label and the features of each text, x as the bytes of its single-precision floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, "text"):
            x = text_features(*bw.buffer(batch.column("text"))).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], ["y", "x"])

    return rows.select("y", F.col(text_col).alias("text")).mapInArrow(run, "y int, x binary")


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of at most ``ROWS`` rows that ``features`` wrote."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            yield np.frombuffer(b"".join(own.column("x").to_pylist()), "<f4").reshape(-1, FEATURES), own.column("y").to_numpy()


def total_of(rows: DataFrame) -> Total:
    """Sums over the rows that ``features`` wrote: a task adds up its own, tasks' sums meet in a shuffle by their chunks."""

    def total(part: Part) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for x, y in labelled(batches):
                mine = part(x, y)
                own = mine if own is None else own + mine
            if own is not None:
                starts = range(0, len(own), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([own[at : at + CHUNK].astype("<f8").tobytes() for at in starts], pa.binary())], ["at", "v"])
            bw.release()

        def add(own: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(v, "<f8") for v in own.column("v").to_pylist())
            return pa.table({"at": own.column("at").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

        got = rows.mapInArrow(work, "at int, v binary").groupBy("at").applyInArrow(add, "at int, v binary").collect()
        return np.frombuffer(b"".join(bytes(r.v) for r in sorted(got, key=lambda r: r.at)), "<f8")

    return total


def value_at(z: DataFrame, rank: int) -> float:
    """The value number ``rank`` (from 0) of the rising column z, exactly: the bin that holds it becomes the range of the next bins, until it has one value."""
    low, high = z.agg(F.min("z"), F.max("z")).first()
    while low < high:
        place = F.least(F.floor((F.col("z") - low) / (high - low) * 1024), F.lit(1023))
        own = z.where(F.col("z").between(low, high)).groupBy(place.alias("bin")).agg(F.count("z").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
        for r in own.orderBy("bin").collect():
            low, high = r.low, r.high
            if rank < r.n:
                break
            rank -= r.n
    return low


def few(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices by bytes of text, of at most ``ROWS`` rows."""
    for batch in bw.slices(batches, column):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = 0.7, penalty: float = 1e-3) -> Ranker:
    """Learn from every document whose id is labelled and not held out; of an id's labels the least counts."""
    own = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("y"))
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are many times their labels: the labels are the side that is held, and no text is sorted
    texts = texts.join(own.hint("shuffle_hash"), F.col("id") == F.col("label_id"))
    rows = staged(features(texts, "text"), "features")

    def middle(model: Ranker, cut: int) -> float:
        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, _ in labelled(batches):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], ["z"])

        z = staged(rows.mapInArrow(raw, "z double"), "scores")
        out = (value_at(z, cut - 1) + value_at(z, cut)) / 2
        drop(z)
        return out

    model = learnt(total_of(rows), middle, accept, penalty)
    drop(rows)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from ``accept`` up), with the columns of ``keep`` beside them.

    Only the text is an input of a score. Null, empty and wordless texts all
    get the score of an all-zero feature row; null ids are scored and are not
    held out; repeated rows each return; unlabelled tables, or labels of one
    class, accept every text; an empty table gives none.
    """
    model = train(docs, labels, id_col, text_col, accept=accept)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, "_text"):
            score = model.score(text_features(*bw.buffer(batch.column("_text"))))
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= accept).astype(np.int32))], [*names, "score", "predicted"])

    names = [id_col, "held_out", *keep]
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), *keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
