"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Copies of a vector fall together first. Centres are fitted on a bounded sample; every vector has a home cell, its nearest
centre. Two unit vectors whose cosine reaches the threshold are at most r = sqrt(2 - 2 * threshold) apart, so if their
homes c and d differ, one of them lies within r / 2 of the plane between c and d. A vector therefore also visits every
other cell whose plane is that near, and each cell compares its home vectors with each other and with its visitors: no
link is lost, whatever the centres are. A cell's vectors are dealt into blocks of bounded size, a pair of blocks is one
unit of work, so a cell with a third of all rows is many units. Links are counted where they are found; of the pairs only
a spanning forest leaves a unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.components import Labels, connected_components
from turnstone.llm.scratch import Scratch

BLOCK = 2048  #: vectors in a block, and about the number in a cell
MAX_CELLS = 4096  #: bounds the centres that are sent to the executors; larger cells are dealt into more blocks
SAMPLE = 20_000  #: vectors from which the centres are fitted
SLACK = 1e-5  #: added to the visiting margin, above what single precision can lose


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres (k, d), started from evenly spaced rows of x. A cell that runs empty keeps its centre."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Classes of vectors linked by cosine >= threshold in double precision.

    Returns one row per input row: id, n_links long (other rows linked directly), component_id (smallest id reachable,
    itself included), kept boolean (id = component_id). A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing and is kept; so does one of another length than the other vector. Repeated rows each count
    and each return; a null id is never kept, and is a component_id only where all ids of the component are null. Other
    columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = raw.select(F.monotonically_increasing_id().alias("rid"), "id", F.when(sound, F.col("v")).alias("v"))
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    rows = scratch.write(rows.withColumn("v", F.col("v").cast(vectors.schema[vector_col].dataType)), "rows")
    nodes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = scratch.write(nodes.withColumn("dim", F.size("v")), "nodes")

    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # one row per vector length
    parts = [_compare(nodes.where(F.col("dim") == dim), n, threshold, block, sample, scratch, f"d{dim}") for dim, n in sorted(sizes.items())]
    found = parts[0] if parts else spark.createDataFrame([], "node long, links long, root long")
    for p in parts[1:]:
        found = found.unionByName(p)
    found = scratch.write(found, "found")

    roots = scratch.write(connected_components(found.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "roots")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    table = nodes.select("k1", "k2", "node", "n", "least").join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    table = scratch.write(table, "classes")
    low = table.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.write(table.join(low, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"), "named")
    out = rows.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _compare(nodes: DataFrame, n: int, threshold: float, block: int, sample: int, scratch: Scratch, label: str) -> DataFrame:
    """(node, links, root): links found per node, possibly in several rows, and a spanning forest as (node, root)."""
    spark = nodes.sparkSession
    k = max(1, min(MAX_CELLS, math.ceil(n / block)))
    some = nodes.select("v") if n <= sample else nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < int(1_000_003 * sample / n)).select("v").limit(2 * sample)
    taken = some.toArrow()["v"]
    centres = fit_centres(matrix(taken), k) if len(taken) else np.zeros((1, 0))
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    sent = spark.sparkContext.broadcast((centres, gaps))
    cells = len(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, gaps = sent.value
        for b in batches:
            x = matrix(b["v"]) if b.num_rows and centres.shape[1] else np.zeros((b.num_rows, 0))
            near = x @ centres.T
            home = near.argmax(axis=1)
            own = near[np.arange(len(x)), home]
            visits = (own[:, None] - near) <= (margin + SLACK) * gaps[home]
            visits[np.arange(len(x)), home] = False
            at = [np.flatnonzero(r).astype(np.int32) for r in visits]
            yield pa.record_batch([b["node"], b["n"], b["v"], pa.array(home.astype(np.int32)), pa.array(at, pa.list_(pa.int32()))], names=["node", "n", "v", "home", "visits"])

    element = nodes.schema["v"].dataType.simpleString()
    placed = scratch.write(nodes.select("node", "n", "v").mapInArrow(place, f"node long, n long, v {element}, home int, visits array<int>"), f"{label}-placed")
    homes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # at most MAX_CELLS rows
    guests = {r["cell"]: r["count"] for r in placed.select(F.explode("visits").alias("cell")).groupBy("cell").count().collect()}
    layout = spark.createDataFrame([(c, math.ceil(h / block), max(1, math.ceil(guests.get(c, 0) / (4 * block))) if guests.get(c) else 0) for c, h in sorted(homes.items())], "cell int, hb int, gb int")
    deal = lambda m: F.pmod(F.xxhash64("node"), m).cast("int")
    unit = lambda i, j: F.struct(F.col("cell"), i.alias("i"), j.alias("j"))
    at_home = placed.withColumn("cell", F.col("home")).join(F.broadcast(layout), "cell").withColumn("mine", deal(F.col("hb")))
    at_home = at_home.withColumn("to", F.transform(F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1), lambda j: unit(F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))))
    at_home = at_home.select("node", "n", "v", "home", "visits", "mine", F.explode("to").alias("unit"))
    visiting = placed.select("node", "n", "v", "home", F.explode("visits").alias("cell")).join(F.broadcast(layout), "cell").withColumn("mine", F.col("hb") + deal(F.greatest("gb", F.lit(1))))
    visiting = visiting.withColumn("to", F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda i: unit(i, F.col("mine"))))
    visiting = visiting.select("node", "n", "v", "home", F.lit(None).cast("array<int>").alias("visits"), "mine", F.explode("to").alias("unit"))
    work = at_home.unionByName(visiting).select("node", "n", "v", "home", "visits", "mine", F.col("unit.cell").alias("cell"), F.col("unit.i").alias("i"), F.col("unit.j").alias("j"))

    def multiply(t: pa.Table) -> pa.Table:
        i, j, cell = t["i"][0].as_py(), t["j"][0].as_py(), t["cell"][0].as_py()
        node, n, home, mine = (t[c].to_numpy() for c in ("node", "n", "home", "mine"))
        x = matrix(t["v"])
        a = np.flatnonzero(mine == i)
        b = a if i == j else np.flatnonzero(mine == j)
        abroad = None
        if (home[b] != cell).any():  # which cells each home vector visits
            abroad = np.zeros((len(node), cells), bool)
            visits = t["visits"].combine_chunks()
            lengths = visits.value_lengths().fill_null(0).to_numpy()
            abroad[np.repeat(np.arange(len(node)), lengths), visits.flatten().to_numpy()] = True
        links, labels = np.zeros(len(node), np.int64), Labels(len(node))
        for s in range(0, len(a), 512):
            p, q = np.nonzero(x[a[s : s + 512]] @ x[b].T >= threshold)
            p, q = a[p + s], b[q]
            if i == j:
                keep = p < q
            elif abroad is not None:  # a pair of a home vector and a visitor that meet in both cells counts in the smaller one
                keep = (cell < home[q]) | ~abroad[p, home[q]]
            else:
                keep = np.ones(len(p), dtype=bool)
            p, q = p[keep], q[keep]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            labels.link(p, q)
        own, root = labels.forest()
        up = np.full(len(node), -1, np.int64)
        up[own] = node[root]
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": pa.array(up[some], mask=up[some] < 0)})

    return work.groupBy("cell", "i", "j").applyInArrow(multiply, "node long, links long, root long")
