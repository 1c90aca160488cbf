"""Connected components by repeated contraction.

Every round each node hooks to the neighbour (or itself) with the smallest hash, edges are rewritten to the hooked
nodes, and loops and repeats go. The graph shrinks geometrically, so the rounds grow with the logarithm of the longest
path. A hub costs nothing special: the hook is a ``min`` with map-side combine. The rows of all rounds stay distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """Components of an undirected graph.

    edges: (a long, b long), in any direction, repeats and loops allowed; null ends are ignored.
    Returns (node long, root long) for every node of an edge that isn't a loop; root is some node of its component, the
    same for all of them. No edges: an empty table.
    """
    spark = scratch.spark
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = scratch.write(live, f"{label}-edges-0")
    hooks: list[DataFrame] = []
    k = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        hook = hook.select("node", F.when(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id")) < F.col("m"), F.col("node")).otherwise(F.col("m.id")).alias("root"))
        hook = scratch.write(hook, f"{label}-hooks-{k}")
        hooks.append(hook)
        step = live.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        step = step.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        k += 1
        nxt = scratch.write(step, f"{label}-edges-{k}")
        scratch.drop(f"{label}-edges-{k - 1}")
        live = nxt
    if not hooks:
        return spark.createDataFrame([], "node long, root long")
    known = hooks[-1]
    for hook in reversed(hooks[:-1]):  # a node's root is its hook's root, or the hook itself where that one had no edge left
        later = known.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = hook.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known


class Labels:
    """Union-find over entries 0..n-1 that takes arrays of links; the smaller root wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[i] = r
        return r

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(entry, its root) for every entry that isn't a root."""
        r = self.roots(np.arange(len(self.up)))
        own = np.flatnonzero(r != np.arange(len(r)))
        return own, r[own]
