"""SimHash near-duplicates of documents, joined by a binary trie.

Fingerprints are computed once for every row. Rows with the same fingerprint fall together before any comparison, so
copies, however many, are one node. With a budget of e differing bits a 64-bit fingerprint is cut into e + 1 blocks, of
which two linked fingerprints share at least one; each distinct fingerprint is therefore sent to e + 1 places, keyed by
(block, its value). There one trie over "key, then the other bits" holds all fingerprints of the partition and is joined
with itself: pairs of nodes descend together, add up the bits in which they differ and go as soon as the budget is
exceeded. A partition reports a spanning forest of its links, never all pairs. A family of near copies fills one partition
only with its distinct fingerprints, which are bounded by the ball of fingerprints around the family, not by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.components import Labels, connected_components
from turnstone.llm.scratch import Scratch
from turnstone.llm.texts import append

SEED = 42
CHUNK = 1 << 18  #: shingles, or pairs of trie nodes, that are held as arrays at once


def simhash(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text: 64 majority votes over the XXH64 (seed 42) of its word shingles, repeats included.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Fewer words than ``size``: the whole sequence is the
    only shingle. No word, or a null text: 0.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only ASCII is lower-cased and split
    if not words:
        return 0
    h, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= size:
        return h(b" ".join(words), seed)
    votes, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[:-1]))[:n].tolist(), (ends[size - 1 :] - 1).tolist()
    for i in range(0, n, CHUNK):
        hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs: (id, text). Returns (id, fp long), fp being the fingerprint's 64 bits as a signed number."""

    def make():
        return lambda texts: (np.array([simhash(t, size) for t in texts], dtype=np.uint64).view(np.int64),)

    return append(docs.select("id", "text"), "text", "fp long", make).drop("text")


def blocks(budget: int) -> list[tuple[int, int]]:
    """budget + 1 runs of bits (shift, width) that cover 64 bits."""
    cuts = [round(64 * k / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def trie_pairs(keys: np.ndarray, fps: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of entries with the same key whose fingerprints differ in at most ``budget`` bits.

    Entries are distinct and sorted by (key, fp). A trie node is a run [lo, hi) of entries that agree on all bits above the
    current one; a pair of nodes carries the bits in which the two differ so far. Pairs are taken depth-first in chunks, so
    memory stays bounded.
    """
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(first[1:], len(keys))
    many = last - first > 1
    stack = [(64, first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int8))]
    while stack:
        depth, la, ha, lb, hb, cost = stack.pop()
        if len(la) > CHUNK:
            half = len(la) // 2
            stack += [(depth, *(x[s] for x in (la, ha, lb, hb, cost))) for s in (slice(half), slice(half, None))]
            continue
        single = (ha - la == 1) & (hb - lb == 1)  # leaves: the rest of the bits at once
        if single.any():
            i, j = la[single], lb[single]
            keep = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            if keep.any():
                yield i[keep], j[keep]
        rest = ~single
        if depth == 0 or not rest.any():
            continue
        la, ha, lb, hb, cost = (x[rest] for x in (la, ha, lb, hb, cost))
        depth -= 1
        ma, mb = split(fps, la, ha, depth), split(fps, lb, hb, depth)
        same = (la == lb) & (ha == hb)
        kids = []
        for a0, a1, b0, b1, add, only in ((la, ma, lb, mb, 0, None), (ma, ha, mb, hb, 0, None), (la, ma, mb, hb, 1, None), (ma, ha, lb, mb, 1, ~same)):
            ok = (a1 > a0) & (b1 > b0) & (cost + add <= budget)
            if only is not None:  # a node with itself: its two children meet once
                ok &= only
            ok &= ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
            kids.append((a0[ok], a1[ok], b0[ok], b1[ok], (cost[ok] + add).astype(np.int8)))
        joined = [np.concatenate(x) for x in zip(*kids, strict=True)]
        if len(joined[0]):
            stack.append((depth, *joined))


def split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For each node [lo, hi) the place of the first entry with the bit set, all higher bits being equal: binary search of all nodes together."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (fps[np.minimum(mid, len(fps) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def links(distinct: DataFrame, budget: int, partitions: int | None = None) -> DataFrame:
    """distinct: (fp long), no repeats. Returns (a, b) long: a spanning forest of each partition's links of at most ``budget`` bits."""
    parts = blocks(budget)
    places = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1) if width < 64 else F.lit(-1)).alias("value")) for k, (shift, width) in enumerate(parts)])
    sent = distinct.select("fp", F.explode(places).alias("p")).select("fp", "p.block", "p.value")
    sent = sent.repartition(partitions, "block", "value") if partitions else sent.repartition("block", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held or not sum(map(len, held)):
            return
        fp = np.concatenate([b["fp"].to_numpy(np.int64) for b in held]).view(np.uint64)
        block = np.concatenate([b["block"].to_numpy(np.int64) for b in held])
        value = np.concatenate([b["value"].to_numpy(np.int64) for b in held])
        del held
        key = (block.astype(np.uint64) << np.uint64(60)) ^ value.view(np.uint64) if len(parts) > 1 else value.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        labels = Labels(len(fp))
        for i, j in trie_pairs(key, fp, budget):
            labels.link(i, j)
        own, root = labels.forest()
        yield pd.DataFrame({"a": fp[root].view(np.int64), "b": fp[own].view(np.int64)})

    return sent.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """SimHash classes of documents.

    Returns one row per input row: (id, fingerprint string of 16 hex digits, component_id). Fingerprints link at ``budget`` or
    fewer differing bits; component_id is the smallest id reachable by links, itself included. Null and empty texts have
    fingerprint 0 and link like any other. A null id stays in the result; it never is a component_id unless all ids of its
    component are null. Repeated rows return repeated rows. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = scratch.write(connected_components(links(nodes.select("fp"), budget), scratch), "roots")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only components of two or more nodes need the second aggregation
    least = linked.where("fp <> root").groupBy("root").agg(F.min("least").alias("others"))
    named = linked.join(least, "root", "left").select("fp", "root", F.least("least", "others").alias("low"))
    top = named.where("fp = root").select(F.col("root"), F.col("low"))
    by_fp = scratch.write(linked.select("fp", "root").join(top, "root", "left").select("fp", F.col("low").alias("component_id")), "by-fp")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """The rows of docs, all columns, of which exactly one of each SimHash class stays.

    That is the row with the smallest id, null ids last; of different texts with that id in the class the one with the smallest
    hash, and of rows equal in both the one whose other columns, as JSON, come first. Different texts that share an id are
    judged apart: none goes for another's sake outside its class. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    name = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(7), text_col).alias("t2"))
    found = near_duplicates(docs.select(name.alias("name"), F.col(text_col).alias("text")), "name", "text", size, budget)
    key = lambda n: [n["no_id"].alias("_no_id"), F.coalesce(n["id"].cast("string"), F.lit("")).alias("_id"), n["t1"].alias("_t1"), n["t2"].alias("_t2")]
    kept = found.where(F.col("name").eqNullSafe(F.col("component_id"))).groupBy("name").agg(F.count(F.lit(1)).alias("_copies"))
    kept = scratch.write(kept.select(*key(F.col("name")), "_copies"), "kept")
    keys = ["_no_id", "_id", "_t1", "_t2"]
    rows = docs.select(F.struct("*").alias("_row"), name.alias("_name")).select("_row", *key(F.col("_name")))
    once = rows.join(kept.where("_copies = 1"), keys, "left_semi").select("_row.*")
    if kept.where("_copies > 1").isEmpty():
        return once
    first = rows.join(kept.where("_copies > 1"), keys, "left_semi").groupBy(*keys).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return once.unionByName(first.select("_row.*"))
