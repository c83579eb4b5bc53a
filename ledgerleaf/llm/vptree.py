"""Nearest neighbours by inner product: vantage-point trees, one a shard.

Inner products become distances by one more component: with M the longest
vector of the shard, x gets sqrt(M*M - x.x) and a query gets 0, so that
squared distance is q.q + M*M - 2 q.x. A node keeps, for the two halves on
either side of the median distance to its vantage point, the least and the
greatest distance. By the triangle inequality a half holds nothing nearer
than the query's distance to that range; it is skipped if this exceeds
``factor`` times the distance of the k-th best so far. Factor one is exact;
smaller factors skip more.

A shard's tree is built once and stored with it in the shared folder, as are
blocks of queries, so a task holds one shard and one block, whatever the
table's size. A task goes through a run of shards and takes the k-th best of
each to the next. Every point that
ties with the k-th best, within rounding, is kept until exact scores decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.pq_dedup import usable
from ledgerleaf.llm.staging import new_path, staged

#: Rows of a shard and of a block of queries; shards that a task searches one after the other; points of a leaf.
SHARD, BLOCK, RUN, LEAF = 8192, 512, 4, 64


def lifted(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Points with the component that makes all equally long, and the square of that length."""
    norm = (x * x).sum(1)
    longest = float(norm.max())
    return np.concatenate([x, np.sqrt(np.maximum(longest - norm, 0))[:, None]], axis=1), longest


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so that a score does not depend on the rows beside it."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Tree:
    """A vantage-point tree over the rows of ``x``, which ``order`` lists leaf by leaf.

    Node i splits the places from lo[i] to hi[i]: left[i] and right[i] are its
    halves, -1 in a leaf; vantage[i] is a row of ``x``; bounds[i] are the least
    and the greatest distance to it in the left half and in the right half.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, stored: dict[str, np.ndarray] | None = None):
        self.points, self.longest = lifted(x)
        if stored is None:
            self.order, nodes, todo = np.arange(len(x)), [], [(0, len(x))]
            rng = np.random.default_rng(len(x))
            while len(nodes) < len(todo):  # nodes are numbered in the order in which they are made
                nodes.append(self._split(*todo[len(nodes)], leaf, rng, todo))
            stored = dict(zip(("lo", "hi", "left", "right", "vantage"), np.array([n[:5] for n in nodes], np.int64).T, strict=True))
            stored["bounds"] = np.array([n[5] for n in nodes], np.float64)
            stored["order"] = self.order
        self.stored = stored
        self.order, self.bounds = stored["order"], stored["bounds"].reshape(-1, 4)
        self.leaves = self.points[self.order]

    def _split(self, lo: int, hi: int, leaf: int, rng: np.random.Generator, todo: list[tuple[int, int]]) -> tuple:
        if hi - lo <= leaf:
            return lo, hi, -1, -1, -1, (0.0, 0.0, 0.0, 0.0)
        own, half = self.order[lo:hi], (hi - lo) // 2
        vantage = int(own[rng.integers(hi - lo)])
        d = np.sqrt(((self.points[own] - self.points[vantage]) ** 2).sum(1))
        turn = np.argpartition(d, half)
        self.order[lo:hi], d = own[turn], d[turn]
        todo += [(lo, lo + half), (lo + half, hi)]
        return lo, hi, len(todo) - 2, len(todo) - 1, vantage, (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inner products of the k best of each query, query, row): the last two hold every point that reaches the k-th best, within rounding.

        ``best`` are the k best inner products found elsewhere; missing ones are -inf.
        """
        best = np.full((len(q), k), -np.inf) if best is None else best.copy()
        norm = (q * q).sum(1)
        base, slack, margin = norm + self.longest, 1e-7 * np.sqrt(norm + self.longest), 1e-9 * np.sqrt(norm * self.longest)
        wide = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo, hi, left, right, vantage = (self.stored[c].tolist() for c in ("lo", "hi", "left", "right", "vantage"))
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            at, own, bound = todo.pop()
            reach = np.sqrt(np.maximum(base[own] - 2 * best[own].min(1), 0))
            own = own[bound <= factor * reach + slack[own]]
            if not len(own):
                continue
            if left[at] < 0:
                near = wide[own] @ self.leaves[lo[at] : hi[at]].T
                i, j = np.nonzero(near >= (best[own].min(1) - margin[own])[:, None])
                found.append((own[i], lo[at] + j, near[i, j]))
                best[own] = -np.partition(-np.concatenate([best[own], near], axis=1), k - 1, axis=1)[:, :k]
                continue
            d = np.sqrt(((wide[own] - self.points[vantage[at]]) ** 2).sum(1))
            a0, a1, b0, b1 = self.bounds[at]
            to_left, to_right = np.maximum(np.maximum(d - a1, a0 - d), 0), np.maximum(np.maximum(d - b1, b0 - d), 0)
            halves = [(left[at], own, to_left), (right[at], own, to_right)]
            # the half that most queries are nearer to is pushed last and searched first
            todo += halves if (to_right < to_left).sum() * 2 > len(own) else halves[::-1]
        query, place, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        keep = score >= best[query].min(1) - margin[query]
        return best, query[keep], self.order[place[keep]]


class Shard:
    """A shard's distinct vectors with their tree, and the ids of each."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.ids, self.begin = columns["ids"], columns["begin"]
        self.x = columns["x"].reshape(len(self.begin), -1)
        self.size = np.diff(np.append(self.begin, len(self.ids)))

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Shard:
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.reshape(-1)))
        begin = np.searchsorted(which.reshape(-1)[order], np.arange(len(distinct)))
        tree = Tree(distinct).stored
        return cls({"ids": ids[order], "begin": begin, "x": distinct.reshape(-1), **tree, "bounds": tree["bounds"].reshape(-1)})

    @property
    def tree(self) -> Tree:
        return Tree(self.x, stored=self.columns)

    def best(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float, known: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The k + 1 best inner products so far, and (query row, vec_id, score) of this shard's part in the answer.

        Copies are one point of the tree; of each the k + 1 smallest ids can
        matter. One of the k + 1 best may be the query itself.
        """
        known, query, point = self.tree.search(q, k + 1, factor, known)
        size = np.minimum(self.size, k + 1)[point]
        index = np.repeat(self.begin[point] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        query, point, own = np.repeat(query, size), np.repeat(point, size), self.ids[index]
        other = own != ids[query]
        query, point, own = query[other], point[other], own[other]
        score = np.concatenate([inner_products(q[query[s : s + 50_000]], self.x[point[s : s + 50_000]]) for s in range(0, len(query), 50_000)] or [np.zeros(0)])
        return known, _top((query, own, score), k)


def _write(store: fs.FileSystem, name: str, columns: dict[str, np.ndarray]) -> None:
    pq.write_table(pa.table({c: [v] for c, v in columns.items()}), name, filesystem=store, compression="zstd")


def _read(store: fs.FileSystem, name: str) -> dict[str, np.ndarray]:
    row = pq.read_table(name, filesystem=store)
    return {c: row.column(c).combine_chunks().values.to_numpy() for c in row.column_names}


def write_parts(rows: DataFrame, path: str, size: int, total: int, trees: bool) -> DataFrame:
    """Deal (id, v, width) rows by hash into parts of about ``size`` and write each as a file, with its tree on request; returns (part, width, file)."""

    def write(own: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        own = own.sort_values("id")
        name = f"{uuid.uuid4().hex}.parquet"
        ids, x = own["id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in own["v"]])
        _write(store, f"{root}/{name}", Shard.build(ids, x).columns if trees else {"ids": ids, "x": x.reshape(-1)})
        return pd.DataFrame({"part": [int(own["part"].iloc[0])], "width": [int(own["width"].iloc[0])], "file": [name]})

    parts = max(1, -(-total // size))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return staged(dealt.groupBy("part", "width").applyInPandas(write, "part int, width int, file string"), "parts")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products, ties to the smaller id.

    A query's own id is no candidate of it. Vectors that are null, zero or
    hold null or non-finite components, and rows without an id, take no part;
    only vectors of equal length meet. Repeated ids are each a candidate, and
    a query repeated under one id is searched once. Empty tables give none.
    Scores are sums of products of the original components in double precision.
    """
    spark = rows.sparkSession
    shape = lambda t: t.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("width"))
    base = shape(rows)
    asked = shape(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    path = new_path(spark, "vptree")
    shards = write_parts(base, f"{path}/shards", shard, base.count(), True)
    blocks = write_parts(asked, f"{path}/blocks", block, asked.count(), False)
    runs = shards.withColumn("run", F.floor(F.col("part") / RUN)).groupBy("width", "run").agg(F.sort_array(F.collect_list("file")).alias("shards"))
    # every block of the stated query set meets every run of shards: a table of file names
    pairs = staged(blocks.select("width", F.col("file").alias("block")).join(runs.hint("merge"), "width"), "pairs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for pair in batch.to_pylist():
                asked = _read(store, f"{root}/blocks/{pair['block']}")
                ids, q = asked["ids"], asked["x"].reshape(len(asked["ids"]), -1)
                known, top = np.full((len(q), k + 1), -np.inf), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for name in pair["shards"]:
                    known, more = Shard(_read(store, f"{root}/shards/{name}")).best(ids, q, k, factor, known)
                    top = _top(tuple(np.concatenate(c) for c in zip(top, more, strict=True)), k)
                row, found, score = top
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.repartition(max(1, pairs.count()), "block", "shards").mapInArrow(search, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(columns: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by score and then id."""
    row, found, score = columns
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], found[place < k], score[place < k]
