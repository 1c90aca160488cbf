"""Substring dedup: removes every word that a long passage covers whose word sequence also starts somewhere else.

The method matches documents against suffix automata of reference shards. Broadcasting automata of all shards would make
each document meet each shard, which grows with the square of the corpus, so documents and shards meet by content:

1. Anchors. Every window of ``length`` words has one, the smallest hash among its runs of ``GRAM`` words. Windows with the
   same words have the same anchor, at the same place within them. Consecutive windows mostly share theirs, so a text has
   about one anchor per fourteen words.
2. Anchors are counted over the corpus. A window whose anchor stands nowhere else is unique; most text ends here, and only
   counts have moved.
3. The other windows of one anchor form a segment. Equal segments fall together with map-side combine; a segment that
   occurs twice repeats as a whole and needs no search.
4. A segment is cut in two by the place of the anchor in the window: windows that have more words left of it and windows that
   have more right of it. All windows of a half share their middle, the anchor and half of the other words, so a half goes to
   the one reference shard that is named by those words, and equal windows meet. Equal halves fall together again.
5. A shard's task builds the suffix automaton of its halves and streams each through it for matching statistics: at every
   word, the longest suffix that occurs at least twice. Where it has ``length`` words or more, they repeat.
6. A shard with more than ``MEMBERS`` different halves, a passage that a good part of the corpus quotes with changes, would be
   much for one task. Its halves are cut in four by the same rule, with a longer middle, and go to the shards of their parts,
   and so on until shards are small; at the latest when a part is one window, equal parts have fallen together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.scratch import Scratch

LENGTH = 35
GRAM = 8
ROWS = 1_000  #: rows that leave a task together
MEMBERS = 4_096  #: different parts of segments in one shard; a larger shard is dealt into shards of smaller parts
CACHE = 100_000  #: words whose hashes a worker remembers
PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def words_of(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, unchanged."""
    return text.encode("utf-8", "replace").split()


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, put together from runs of powers of two."""
    out, width, done, power = None, 1, 0, h
    k = 0
    while n:
        if n & 1:
            part = power[done : len(power)] if done else power
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = mix(out[:m] * np.uint64(PRIMES[k % 6]) + part[:m])
            done += width
        n >>= 1
        if n:
            power = mix(power[:-width] * np.uint64(PRIMES[(k + 1) % 6]) + power[width:]) if len(power) > width else power[:0]
            width *= 2
        k += 1
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(PRIMES[0])
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[list[bytes]], hashes: WordHashes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, segment's hash, first window, number of windows, words before the anchor) of every run of windows that share their leftmost smallest run of ``gram`` words."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.array([hashes[w] for t in texts for w in t], dtype=np.uint64)
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(flat) < length:
        return empty
    value = rolled(flat, gram)
    place = np.arange(len(value))
    width, goal = 1, length - gram + 1
    while width < goal:  # sliding minimum, leftmost place of ties
        step = min(width, goal - width)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        width += step
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[: len(value)] == owner[length - 1 :]
    starts = np.flatnonzero(inside & np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1])))
    if not len(starts):
        return empty
    changes = np.flatnonzero(~inside | np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1])))
    ends = np.append(changes, len(value))[np.searchsorted(changes, starts, side="right")]
    at = np.concatenate(([0], np.cumsum(counts)))[owner[starts]]
    return owner[starts], value[starts].view(np.int64), spans_hash(flat, starts, ends + length - 1).view(np.int64), starts - at, ends - starts, place[starts] - starts


def spans_hash(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end): differences of running sums of values times powers of an odd number's inverse, brought to a common place."""
    n = len(flat) + 1
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, PRIMES[2], np.uint64))))
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, pow(PRIMES[2], -1, 1 << 64), np.uint64))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(flat * inverse[:-1])))
    return mix((sums[ends] - sums[starts]) * power[starts] + (ends - starts).astype(np.uint64))


_HASHES = WordHashes()  #: of this worker


def known_hashes() -> WordHashes:
    if len(_HASHES) > CACHE:
        _HASHES.clear()
    return _HASHES


class Automaton:
    """Generalized suffix automaton over words, with the number of places where each state's strings end."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of p's longest string with w added, made out of q where q also holds longer strings."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes], times: int = 1) -> None:
        """Add one sequence that occurs ``times`` times."""
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = self._split(last, q, w)
            else:
                new = self._state(self.len[last] + 1, 0, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][w], w)
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Carry the counts to the suffixes; once, after the last ``add``."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[bytes], length: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) covered by runs of ``length`` words that occur at least twice."""
        spans: list[tuple[int, int]] = []
        at, size = 0, 0
        for i, w in enumerate(words):
            q = self.next[at].get(w)
            while at and (q is None or self.count[q] < 2):
                at = self.link[at]
                size = self.len[at]
                q = self.next[at].get(w)
            if q is None or self.count[q] < 2:
                at = size = 0
                continue
            at, size = q, size + 1
            if size >= length:
                if spans and i - length + 1 <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i - length + 1, i + 1))
        return spans


def halves(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range of numbers of words before the anchor, cut in two."""
    return [(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)] if hi > lo else []


def quarters(lo: int, hi: int) -> list[tuple[int, int]]:
    return [q for h in halves(lo, hi) for q in halves(*h) or [h]]


def part(words: list[bytes], lead: int, lo: int, hi: int, length: int) -> tuple[int, int, list[bytes], bytes, bytes] | None:
    """The windows with ``lo`` to ``hi`` words before the anchor, out of a run of words whose first window has ``lead``.

    Returns (first word, words before the anchor, words, digest of what all such windows share, digest of the whole), or None.
    """
    most, least = min(hi, lead), max(lo, lead - (len(words) - length))
    if least > most:
        return None
    own = words[lead - most : lead - least + length]
    tag = b"%d %d " % (lo, hi)
    shared = words[lead - lo : lead - hi + length]
    return lead - most, most, own, xxhash.xxh128_digest(tag + b" ".join(shared)), xxhash.xxh128_digest(tag + b"%d " % most + b" ".join(own))


_KEY = "k1 long, k2 long"
_MARK = f"{_KEY}, a int, b int"
_PART = f"{_KEY}, a int, n int, lo int, hi int, lead int, c long, s1 long, s2 long, f1 long, f2 long, words binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = "k1 k2 a n lo hi lead c s1 s2 f1 f2 words".split()


def batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)


def part_rows(k1: int, k2: int, first: int, c: int, words: list[bytes], lead: int, ranges: list[tuple[int, int]], length: int) -> Iterator[tuple]:
    for lo, hi in ranges:
        if cut := part(words, lead, lo, hi, length):
            at, most, own, shared, whole = cut
            ids = [int.from_bytes(d[x : x + 8], "little", signed=True) for d in (shared, whole) for x in (0, 8)]
            yield (k1, k2, first + at, len(own), lo, hi, most, c, *ids, b" ".join(own))


def repeated_spans(texts: DataFrame, length: int = LENGTH, members: int = MEMBERS) -> DataFrame:
    """texts: (k1, k2, text), k1 and k2 being hashes of the text; copies of a text stand in as many rows as there are.

    Returns (k1, k2, spans array<struct<a, b>>): words a to b, b left out, that repeat; spans may touch or overlap.
    """
    scratch = Scratch(texts.sparkSession, "substring")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                owner, h, k, first, n, lead = anchors([words_of(t) for t in b["text"].to_pylist()], known_hashes(), length)
                owner = pa.array(owner)
                yield pa.record_batch([b["k1"].take(owner), b["k2"].take(owner), h, k, *(x.astype(np.int32) for x in (first, n, lead))], names=["k1", "k2", "h", "k", "first", "n", "lead"])

    every = scratch.write(texts.select("k1", "k2", "text").mapInArrow(runs, f"{_KEY}, h long, k long, first int, n int, lead int"), "every")
    # written first, so that both sides of the join are dealt by it and a hot anchor's rows can be split
    dup = scratch.write(every.groupBy("h").count().where("count > 1").select("h"), "anchors")
    found = scratch.write(every.join(dup, "h", "left_semi"), "runs")
    scratch.drop("every")
    segments = found.groupBy("h", "k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "first", "n", "lead")).alias("one"))
    segments = scratch.write(segments.select("h", "k", "c", "one.*"), "segments")
    whole = found.join(segments.where("c > 1").select("h", "k"), ["h", "k"], "left_semi")
    marks = whole.select("k1", "k2", F.col("first").alias("a"), (F.col("first") + F.col("n") + length - 1).alias("b")).distinct()

    several = segments.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("least")).where("d > 1 AND least = 1").select("h")
    several = scratch.write(several, "several")  # read again, both sides of the join are dealt anew and a hot anchor's rows can be split
    wanted = segments.join(several, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("c", "first", "n", "lead", "h", "k")).alias("wanted"))
    # written first, so that both sides of the join are dealt by it and a text with very many copies can be split
    sources = texts.select("k1", "k2", "text").join(scratch.write(wanted, "wanted"), ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies of a text give the same segments; most go here, the rest when parts fall together
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b, out = whole.slice(s, 64), []
                for k1, k2, text, wanted in zip(*(b[c].to_pylist() for c in ("k1", "k2", "text", "wanted")), strict=True):
                    words = None
                    for w in wanted:
                        if (name := (w["h"], w["k"])) not in seen:
                            seen.add(name)
                            words = words or words_of(text)
                            out += part_rows(k1, k2, w["first"], w["c"], words[w["first"] : w["first"] + w["n"] + length - 1], w["lead"], halves(0, length - GRAM), length)
                            if len(out) >= ROWS:
                                yield batch(out, _TYPES, _NAMES)
                                out = []
                if len(seen) > 50_000:
                    seen.clear()
                yield batch(out, _TYPES, _NAMES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, a, lo, hi, lead, c, line in zip(*(b[x].to_pylist() for x in ("k1", "k2", "a", "lo", "hi", "lead", "c", "words")), strict=True):
                out += part_rows(k1, k2, a, c, line.split(b" "), lead, quarters(lo, hi), length)
                if len(out) >= ROWS:
                    yield batch(out, _TYPES, _NAMES)
                    out = []
            yield batch(out, _TYPES, _NAMES)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
            distinct = {r[:2]: r for r in rows}
            automaton = Automaton()
            parts = [(r, r[-1].split(b" ")) for r in distinct.values()]
            for r, words in parts:
                automaton.add(words, r[5])
            automaton.finish()
            return [(r[2], r[3], r[4] + a, r[4] + b) for r, words in parts if r[5] == 1 for a, b in automaton.repeated(words, length)]

        held, name, spot = [], None, [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for s1, s2, *r in zip(*(b[c].to_pylist() for c in ("s1", "s2", "f1", "f2", "k1", "k2", "a", "c", "words")), strict=True):
                if held and (s1, s2) != name:
                    out += shard(held)
                    held = []
                name = (s1, s2)
                held.append(tuple(r))
            yield batch(out, spot, ["k1", "k2", "a", "b"])
        if held:
            yield batch(shard(held), spot, ["k1", "k2", "a", "b"])

    whole_part, shard_name, level = ["s1", "s2", "f1", "f2"], ["s1", "s2"], 0
    parts = scratch.write(sources.mapInArrow(cut, _PART), "parts-0")
    while True:
        # copies of one part of one text are one; parts with the same words in different places are counted
        places = parts.groupBy(*whole_part, "k1", "k2", "a").agg(F.max("c").alias("c"))
        keys = scratch.write(places.groupBy(*whole_part).agg(F.sum("c").alias("c"), F.min(F.struct("k1", "k2", "a")).alias("one")), f"keys-{level}")
        shards = keys.groupBy(*shard_name).agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("least")).where("d > 1 AND least = 1").select(*shard_name, "d")
        shards = scratch.write(shards, f"shards-{level}")
        folded = parts.where("c = 1").join(keys.where("c > 1").select(*whole_part), whole_part, "left_semi")
        marks = marks.unionByName(folded.select("k1", "k2", "a", (F.col("a") + F.col("n")).alias("b")).distinct())
        # one of the places of each part of a shard that isn't unique goes on, with the number of all
        one = scratch.write(keys.join(shards, shard_name).select(*whole_part, "c", "d", "one.*"), f"one-{level}")
        picked = parts.drop("c").join(one, [*whole_part, "k1", "k2", "a"])
        small = picked.where(F.col("d") <= members).repartition(*shard_name).sortWithinPartitions(*shard_name)
        marks = marks.unionByName(small.mapInArrow(match, _MARK))
        if shards.where(F.col("d") > members).isEmpty():
            break
        level += 1
        parts = scratch.write(picked.where(F.col("d") > members).mapInArrow(deal, _PART), f"parts-{level}")
    return scratch.write(marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, members: int = MEMBERS) -> DataFrame:
    """docs with n_words long, n_removed long and kept string: the words that no repeated passage covers, joined by one space.

    A passage of ``length`` words repeats if its word sequence also starts anywhere else, in the same text too; all its
    copies go. Null and empty texts have no words; shorter texts lose none. Rows keep their other columns; repeated rows are
    copies of each other. An empty table gives an empty result. Columns k1, k2, spans, n_words, n_removed and kept are replaced.
    """
    own = docs.drop("k1", "k2", "spans", "n_words", "n_removed", "kept")
    keyed = own.withColumns({"k1": F.xxhash64(text_col), "k2": F.xxhash64(F.lit(7), text_col)})
    spans = repeated_spans(keyed.where(F.col(text_col).isNotNull()).select("k1", "k2", F.col(text_col).alias("text")), length, members)
    joined = keyed.join(spans, ["k1", "k2"], "left").select(*own.columns, "spans")
    at, n = own.columns.index(text_col), len(own.columns)
    names = [*own.columns, "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b, out = whole.slice(s, 256), []
                for text, spans in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), strict=True):
                    words = words_of(text or "")
                    kept, last = words, 0
                    if spans:
                        kept = []
                        for x in sorted((x["a"], x["b"]) for x in spans):
                            kept += words[last : max(last, x[0])]
                            last = max(last, x[1])
                        kept += words[last:]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
                added = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *added], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
