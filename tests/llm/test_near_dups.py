import math
import random

import numpy as np
import pytest
import xxhash

from tests.conftest import DATA
from turnstone.llm import components, embed_dedup, simhash
from turnstone.llm.scratch import Scratch


def smallest_reachable(near):
    lab = np.arange(len(near))
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            return lab
        lab = new


def slow_simhash(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if (text or "").isascii() else (text or "").encode().lower().decode().split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "a", "A  b\tC", "a b c d", "the Ä the Ä the Ä x", "x " * 50])
def test_fingerprint(text):
    assert simhash.simhash(text) == slow_simhash(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_join_finds_all_pairs(budget):
    rng = random.Random(budget)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = np.array(sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for s in seeds for _ in range(15)}), dtype=np.uint64)
    found = {(int(i), int(j)) for a, b in simhash.trie_pairs(np.zeros(len(fps), np.uint64), fps, budget) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget}


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps = np.array([int(x, 16) for x in got["fingerprint"]], dtype=np.uint64)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(f) == slow_simhash(texts[i]) for i, f in list(zip(got["doc_id"], fps, strict=True))[:150])
    lab = smallest_reachable([np.flatnonzero(np.bitwise_count(fps ^ f) <= 2) for f in fps])
    assert (got["doc_id"].to_numpy()[lab] == got["component_id"].to_numpy()).all()


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)[:2] == [1, 2]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 501), (501, 500)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 40, 61]
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.12 * rng.normal(size=(60, 16)), np.repeat(base[:3], 30, axis=0), base[5] + 0.15 * rng.normal(size=(120, 16))])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df, block=block).toPandas().sort_values("vec_id")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    assert (got["n_links"].to_numpy() == near.sum(axis=1) - 1).all()
    assert (got["component_id"].to_numpy() == smallest_reachable([np.flatnonzero(n) for n in near])).all()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [2e30, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, node string, v string")
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert got[None] == (0, None, False)
    assert embed_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0
