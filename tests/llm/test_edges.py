"""Long texts, many matches, every code point, repeated ids: cases that the tables don't hold."""

import itertools
import time
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turnstone.llm import bpe, langid, packing, secret_scan, simhash

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = {"spaces": " " * 1_000_000, "inside": "word " + "\n \t" * 400_000 + " word", "letters": "x" * 1_000_000, "digits": "1" * 300_000, "marks": "!" * 300_000, "han": "日本" * 200_000}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_code_point_is_encoded_as_by_the_library():
    own, lib = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(codes), 8192):
        texts = [f"a{c}a 1{c}" for c in codes[i : i + 8192]]
        for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == e.ids, ascii(text)
    rng = np.random.default_rng(0)
    for _ in range(300):  # composition and marks in longer words
        text = "".join(map(chr, rng.choice([*range(33, 127), *range(0xC0, 0x180), *range(0x300, 0x340), 0x20, 0xA0, 0x345, 0x1E9E, 0x3A3, 0x1C5, 0x1100, 0x1161, 0xAC00, 0x1F600], 40)))
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_packing_against_brute_force(spark):
    """Pieces, starts and checksums of every text, very long runs included, and gapless sequences."""
    lib = Tokenizer.from_file(BYTE)
    lib.no_truncation()
    texts = [*LONG.values(), None, "", "a", *("some words of a text %d " % k * (k % 400) for k in range(600))]
    want = {}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(i, k): (a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(itertools.pairwise(at))}
    p = packing.pack_documents(frame(spark, texts), BYTE).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in p.itertuples()} == want and len(p) == len(want)
    p = p.sort_values(["sequence_id", "offset"])
    assert (p.groupby("sequence_id")["length"].cumsum() - p["length"] == p["offset"]).all() and p.groupby("sequence_id")["length"].sum().max() <= 2048


def test_packer_is_best_fit_and_closes_the_fullest():
    rng = np.random.default_rng(5)
    packer, open_, count = packing.Packer(100, 7), {}, 0
    for size in rng.integers(1, 101, 3000).tolist():
        name, offset = packer.place(size)
        fits = [f for f in open_.values() if f >= size]
        if fits:
            assert open_[name] == min(fits)
        else:
            assert name == count
            open_[name], count = 100, count + 1
        assert offset == 100 - open_[name]
        open_[name] -= size
        if not open_[name]:
            del open_[name]
        if len(open_) > 7:
            least = min(open_.values())
            assert len(packer.open_bins()) == 7
            (gone,) = open_.keys() - packer.open_bins()
            assert open_.pop(gone) == least
    assert packer.open_bins() == set(open_)


def test_one_row_of_each_class_stays_when_ids_repeat(spark):
    near = " ".join(f"w{k}" for k in range(400))
    rows = [(5, "alpha beta gamma delta", "x"), (5, "quite another text of five", "x"), (7, "third text here with words", "x"), (None, "alpha beta gamma delta", "y"), (9, "alpha beta gamma delta", "z"), (None, "text without an id at all", "a"), (None, "text without an id at all", "b")]
    rows += [(3, near, "b"), (3, near, "a"), (3, near, "a"), (3, near + " w400", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.source) for r in simhash.keep_one(d).collect()), key=repr)
    classes = {}
    for r, (i, t, _) in zip([simhash.simhash(t) for _, t, _ in rows], rows, strict=True):
        classes.setdefault(next((c for c in classes if (c ^ r).bit_count() <= 2), r), []).append((i, t))
    assert len(got) == len(classes)
    assert (5, "alpha beta gamma delta", "x") in got and (5, "quite another text of five", "x") in got and (7, "third text here with words", "x") in got
    assert (None, "text without an id at all", "a") in got and [g for g in got if g[1] == near] in ([], [(3, near, "a")])


def slow_viterbi(scores, penalty):
    best, paths = scores[0].copy(), [[k] for k in range(scores.shape[1])]
    for s in scores[1:]:
        come = [max(range(len(best)), key=lambda j, k=k: (best[j] - (penalty if j != k else 0), j == k)) for k in range(len(best))]
        paths = [[*paths[j], k] for k, j in enumerate(come)]
        best = np.array([best[j] - (penalty if j != k else 0) + s[k] for k, j in enumerate(come)])
    return float(best.max()), paths[int(best.argmax())]


@pytest.mark.parametrize("k", [2, 5, 300])
def test_viterbi_against_brute_force(k):
    rng = np.random.default_rng(k)
    lengths = np.array([1, 7, 30, 2], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores = (rng.normal(size=(lengths.sum(), k)) * 4).astype(np.float32)
    path = langid.viterbi(scores, starts, lengths, 3.0)
    for s, n in zip(starts, lengths, strict=True):
        own, part = path[s : s + n], scores[s : s + n].astype(float)
        value = part[np.arange(n), own].sum() - 3.0 * (own[1:] != own[:-1]).sum()
        assert own.min() >= 0 and own.max() < k and abs(value - slow_viterbi(part, 3.0)[0]) < 1e-3
    two = np.full((2, k), -50.0, np.float32)
    two[0, k - 1] = two[1, 1] = 0
    assert langid.viterbi(two, np.array([0]), np.array([2]), 3.0).tolist() == [k - 1, 1]


def test_the_most_frequent_languages_are_learned(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"word{i % 5} of lang{i % 5}", f"l{i % 5}", "s", 0) for i in range(40)] + [(99, "rare words", "dirty", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.fit(d, F.lit(True)).languages == ["dirty", "l0", "l1", "l2", "l3", "l4"]
    assert langid.fit(d, F.lit(True), max_languages=5).languages == ["l0", "l1", "l2", "l3", "l4"]


def test_many_matches_in_one_text(spark):
    """Spans at every fold length around the chunk, and a text with 20,000 of them in a few seconds."""
    counts = [0, 1, 127, 128, 129, 256, 257, 1000, 20_000]
    texts = ["🙂 ".join(["deadbeefdeadbeef0"] * n) + " é" for n in counts]
    start = time.monotonic()
    got = {r.doc_id: r.spans for r in secret_scan.digests(frame(spark, texts)).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, texts)).collect()}
    assert time.monotonic() - start < 60
    for i, n in enumerate(counts):
        assert got[i] == ",".join(f"hex:{19 * k}:{19 * k + 17}" for k in range(n))
        assert clean[i] == "🙂 ".join(["[REDACTED]"] * n) + " é"


def test_overlapping_spans_are_replaced_together(spark):
    texts = ["a token=deadbeefdeadbeefdeadbeef b " * 300, "password=abcdefabcdefabcdef012345password=abcdefghijklmnop", "x"]
    clean = [r.text for r in secret_scan.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert clean == ["a [REDACTED] b " * 300, "[REDACTED]", "x"]


@pytest.mark.parametrize("name", LONG)
def test_long_runs(spark, name):
    d = frame(spark, [LONG[name]])
    assert secret_scan.digests(d).count() == 1 and len(simhash.near_duplicates(d).collect()) == 1
    r = bpe.round_trip_digests(d, WORD).collect()[0]
    assert r.n_tokens == len(Tokenizer.from_file(WORD).encode(LONG[name], add_special_tokens=False).ids)
