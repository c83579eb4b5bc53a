"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.staging import drop, staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of these links: (node, smallest node reachable), without the smallest ones themselves."""
    if not len(a):
        return a[:0], a[:0]
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        for at in (ia, ib, label[ia], label[ib]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node it reaches, itself included.

    Each round writes its links to the shared folder and deletes the round's before.
    Rounds end when all links lead to a root; their number grows with the logarithm of the longest chain; a hot node costs a map-side
    minimum and a join whose skewed partitions Spark can split.
    Links that hold a null are ignored; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    e = staged(
        links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "links",
    )
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, staged(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(large)
        drop(before)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Does every node have one link up, and to a node that has none?"""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    each = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not each.where("ups > 1 or (ups = 1 and least = 0)").head(1)
