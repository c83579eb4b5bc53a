"""Whitening of embeddings by the leading eigenvectors of their covariance, with a block Jacobi-Davidson method.

The covariance is never formed. All that is asked of the data are centred
products: for a block of directions U, one pass over the distinct vectors
sums c (c U) over the centred rows c, in doubles; centred entries are exact
integers over n. A pass brings d times the block's width of numbers to the
driver, whatever the number of rows.

Each round takes Ritz pairs from the search space (Rayleigh-Ritz), locks the
leading ones whose residual is at double precision, and solves the projected
correction equation for the leading open ones together: MINRES, one recurrence a
column, one pass a step. The answers widen the search space; it is cut
back to its leading Ritz vectors when it is too wide. The method ends when all
wanted pairs are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.staging import staged

Product = Callable[[np.ndarray], np.ndarray]
#: Scaled entries beyond this are held at it, so that sums of millions of them fit in 64 bits.
LARGEST = 1 << 40


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal columns ``against``; directions within rounding of them drop."""
    out = np.zeros((len(block), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - against @ (against.T @ v)
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size and out.shape[1] + against.shape[1] < len(block):
            v = v / left
            v = v - against @ (against.T @ v) - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def minres(apply: Product, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one for each column of ``right``, by MINRES from zero; a step is one call of ``apply`` on all columns.

    Ends after ``steps``, or when every residual has fallen to ``enough`` of its start.
    """
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, before = right / first, np.zeros_like(right)
    x, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    # Givens rotations of the last two steps, the residual norm and its part in the next entry
    c0, s0, c1, s1 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, last = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - last * before
        then = np.linalg.norm(y, axis=0)
        top, mid = s0 * last, c0 * last
        mid, low = c1 * mid + s1 * alpha, c1 * alpha - s1 * mid
        size = np.hypot(low, then)
        safe = np.where(size > 0, size, 1.0)
        c, s = np.where(size > 0, low / safe, 1.0), np.where(size > 0, then / safe, 0.0)
        new = (v - mid * w - top * w_before) / safe
        x = x + np.where(size > 0, c * eta, 0.0) * new
        eta = -s * eta
        w_before, w, c0, s0, c1, s1 = w, new, c1, s1, c, s
        before, v, last = v, y / np.where(then > 0, then, 1.0), then
        if (np.abs(eta) <= enough * beta).all():
            break
    return x


def jacobi_davidson(product: Product, d: int, k: int, extra: int = 8, widest: int = 4, steps: int = 6, seed: int = 7, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, falling, unit eigenvectors as columns, residual norms) of the ``k`` largest of a symmetric ``product`` of order ``d``.

    A pair is locked when its residual is within 4 sqrt(d) roundings of the
    largest eigenvalue, or when the search space can grow no more. ``extra``
    directions beyond ``k`` start the search, which holds ``widest`` such
    blocks at most.
    """
    k = min(k, d)
    block = min(d, k + extra)
    rng = np.random.default_rng(seed)
    locked, values, norms = np.zeros((d, 0)), [], []
    space = orthonormal(rng.normal(size=(d, block)), locked)
    image = product(space)
    top, worst, still = 0.0, np.inf, 0
    for _ in range(rounds):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(top, float(theta[0]))
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        open_ = k - len(values)
        tolerance = 4 * np.sqrt(d) * np.finfo(float).eps * top
        full = locked.shape[1] + space.shape[1] >= d
        still = still + 1 if size[:open_].max() >= 0.5 * worst else 0
        worst = min(worst, float(size[:open_].max()))
        done = 0
        # a space that is whole, or no better for some rounds at rounding's level, gives what doubles can
        while done < open_ and (size[done] <= tolerance or full or (still >= 3 and size[done] <= 64 * tolerance)):
            done += 1
        if done:
            locked = np.column_stack([locked, orthonormal(space[:, :done], locked)])
            values += theta[:done].tolist()
            norms += size[:done].tolist()
            space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
            worst, still = np.inf, 0
        if len(values) == k:
            break
        open_ = k - len(values)
        if space.shape[1] > widest * block:
            keep = max(block, 2 * open_)
            space, image = space[:, :keep], image[:, :keep]
        ritz, shift = space[:, :open_], theta[:open_]
        held = np.column_stack([locked, ritz])
        project = lambda x, q=held: x - q @ (q.T @ x)
        answer = minres(lambda x, s=shift, p=project: p(product(x) - x * s), project(-residual[:, :open_]), steps, 1e-2)
        added = orthonormal(answer, np.column_stack([locked, space]))
        if not added.shape[1]:
            added = orthonormal(rng.normal(size=(d, open_)), np.column_stack([locked, space]))
        space, image = np.column_stack([space, added]), np.column_stack([image, product(added)])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(norms)[order]


class _Fit:
    """Distinct integer vectors of one length, their number, sums and centred products."""

    def __init__(self, rows: DataFrame, d: int) -> None:
        self.rows, self.d = rows, d
        n_and_sums = self._pass(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long")
        self.n, self.sums = int(n_and_sums[0]), n_and_sums[1:]

    def _pass(self, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
        """The sum over all rows' batches of an array that ``part`` makes of a batch, entry by entry: partial sums meet in a shuffle, the driver gets one array."""
        d, dtype = self.d, np.int64 if kind == "long" else np.float64

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    mine = part(batch.column("x").flatten().to_numpy().reshape(-1, d)).ravel()
                    total = mine if total is None else total + mine
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(dtype))], ["at", "v"])

        got = self.rows.mapInArrow(work, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(int(got["at"].max()) + 1, dtype)
        out[got["at"].to_numpy()] = got["v"].to_numpy()
        return out

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n, one rounding an entry."""
        n, sums = self.n, self.sums
        return lambda x: exact_deviation(x, n, sums)[0] / n

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``block``."""
        centred = self.centred()
        return self._pass(lambda x: (c := centred(x)).T @ (c @ block), "double").reshape(block.shape) / self.n

    def trace(self) -> float:
        centred = self.centred()
        return float(self._pass(lambda x: np.array([np.square(centred(x)).sum()]), "double")[0]) / self.n

    def identity_error(self, turn: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the rows' images under ``turn``, less the identity."""
        centred = self.centred()
        mean = self._pass(lambda x: (centred(x) @ turn).sum(axis=0), "double") / self.n
        cov = self._pass(lambda x: (w := centred(x) @ turn - mean).T @ w, "double").reshape(turn.shape[1], -1) / self.n
        return float(np.abs(cov - np.eye(turn.shape[1])).max())


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S as doubles, is every step of it and of the sum of its squares within 64 bits?, for each row)."""
    far = np.abs(x.astype(float) * n) + np.abs(sums.astype(float))
    if far.max(initial=0.0) < 2.0**62:
        y = (x * n - sums).astype(float)
    else:  # x - S/n loses nothing that a double could hold
        y = (x.astype(float) - sums / n) * n
    return y, (far.max(axis=1, initial=0.0) < 2.0**62) & (np.square(y).sum(axis=1) < 2.0**62)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error, residual.

    An entry c becomes floor(``scale`` c) + ``shift``; the fit is over distinct
    such vectors. Rows whose vector is null, empty or holds null or non-finite
    entries drop. Repeated rows each return and count once in the fit; null
    ids stay null. Vectors of different lengths are fitted apart, length by
    length. Components without variance (the rank may be less than
    ``components``; a single distinct vector has none) return nothing; equal
    eigenvalues share their space in some basis. An empty table gives no rows. ``deviation`` is null
    where it does not fit a long. Other columns are not read. ``residual`` is
    the norm of V u - e u over the largest eigenvalue.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    c = F.col("v")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(c.isNotNull() & (F.size(c) > 0) & fine)
    held = lambda e: F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), e * scale))
    rows = staged(own.select("id", F.transform(c, lambda e: F.floor(held(e)) + F.lit(shift)).alias("x")), "vectors")
    distinct = staged(rows.select("x").distinct(), "distinct_vectors")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    out = spark.createDataFrame([], schema)
    for (d,) in distinct.groupBy(F.size("x").alias("d")).count().select("d").orderBy("d").toLocalIterator():
        mine = lambda table, d=d: table.where(F.size("x") == d)
        out = out.union(_whitened(mine(rows), _Fit(mine(distinct), d), components, schema))
    return out.withColumnRenamed("id", id_col)


def _whitened(rows: DataFrame, fit: _Fit, components: int, schema: str) -> DataFrame:
    trace = fit.trace()
    if trace <= 0:
        return rows.sparkSession.createDataFrame([], schema)
    values, axes, norms = jacobi_davidson(fit.product, fit.d, components)
    good = values > fit.d * np.finfo(float).eps * 16 * values[0]
    values, axes, norms = values[good], axes[:, good], norms[good]
    turn = axes / np.sqrt(values)
    error = fit.identity_error(turn)
    k, n, d, sums = len(values), fit.n, fit.d, fit.sums
    residual = norms / values[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(m, d)
            y, fits = exact_deviation(x, n, sums)
            exact = np.where(fits[:, None], x, 0) * n - np.where(fits[:, None], sums, 0)
            deviation = pa.array(np.repeat(np.square(exact).sum(axis=1), k), mask=np.repeat(~fits, k))
            each = lambda v: pa.array(np.tile(v, m))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m * k, n, np.int64)), deviation,
                 pa.array(((y / n) @ turn).ravel()), each(values / trace), pa.array(np.full(m * k, error)), each(residual)],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return rows.mapInArrow(project, schema)
