"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine, trained on labelled sentences.

The kernel of two strings counts the runs of three or four letters that both contain in order, gaps allowed; one that spans
more letters weighs less. It so tolerates inserted and missing letters. A sentence is compared by its parts, its words and
pairs of neighbouring words, in which the space is a letter that every run skips: an insult is one or two words among many
harmless ones, which would drown it if the sentence were one string. A sentence scores as the worst of its parts does, a text
as the worst of its sentences.

Training is that of a multiple-instance machine: the sentences' labels, which are those of their texts, say only that some
part, the witness, is toxic. The first witnesses are parts that stand in toxic sentences far more often than chance allows,
words or, where no word of theirs does by itself, pairs; also with a letter put in. Then the machine is fitted again on each
labelled text's own witness, its worst part, of harmless texts as well as of toxic ones.
The machine is fitted on Nystroem features, the kernel values at the landmarks times the inverse root of the landmarks'
kernel matrix. As the kernel is a product of sparse features, the fitted machine folds into one weight per run, and a new
word costs a few look-ups. Texts' best values are turned into scores by a logistic curve fitted on the labelled texts.
Runs of four letters share numbers by a hash, as do letters beyond a-z, so the kernel is that of their numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.scratch import Scratch
from turnstone.llm.texts import append

TRAIN_DOCS = 20_000  #: expected number of labelled rows in the sample that the model is fitted on
LANDMARKS, NEGATIVES = 256, 6_000  #: rank of the machine; size of the sample of harmless words it is first fitted on
WORD = 64  #: a longer run of letters is taken in pieces of so many, each of which overlaps half of the next
AT_ONCE = 100_000  #: letters whose runs are held as arrays
ROUNDS = 1  #: times that the machine is fitted again on the texts' witnesses; more change little
SPAN, DECAY = 6, 0.6  #: letters that a run may span; weight of each letter that it skips
CACHE = 400_000
LIKE = 0.6  #: kernel value from which a word counts as the half of a toxic pair
FLOOR = -3.0  #: value of a text without a word
SENTENCE = r"[.!?\n]+"
LETTERS = 64
CODES = 1 << 20

_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])")
_NO_LETTER = re.compile(r"[^\w\s]|[\d_]")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_GAPS = [g for n in (2, 3) for g in product(range(1, SPAN), repeat=n) if sum(g) < SPAN]


def words_of(text: str) -> list[str]:
    """Lower-cased words without marks and digits; digits inside a word stand for the letters they resemble; letters written apart are one word."""
    text = _INSIDE.sub(lambda m: "".join(_LOOKALIKE[c] for c in m[0]), text.lower())
    words = _NO_LETTER.sub("", text).split()
    if sum(len(w) == 1 for w in words) >= 3:
        line = " ".join(words)
        words = _SPACED.sub(lambda m: m[0].replace(" ", ""), line).split(" ") if line else []
    if any(len(w) > WORD for w in words):
        words = [w[k : k + WORD] for w in words for k in range(0, max(1, len(w) - WORD // 2), WORD // 2)]
    return words


def runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, weights and owners of all words' subsequences of three and four letters, and each word's norm, in which a repeated run counts anew each time. Words' ends count as letters, a space in a pair is skipped.

    Codes of three letters are their own; those of four are hashed into the rest of ``CODES``.
    """
    line = "".join(f"\x01{w}\x02\x00\x00\x00\x00\x00" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    owner = np.cumsum(codes == 1) - 1
    letter = np.where(codes < 3, codes, np.where((codes >= 97) & (codes <= 122), codes - 94, 30 + codes * 40503 % (LETTERS - 30)))
    letter[(codes == 0) | (codes == 32)] = -1
    n, found, weights, owners = len(letter), [], [], []
    for gaps in _GAPS:
        end = sum(gaps)
        code, ok, at = letter[: n - end], letter[: n - end] >= 0, 0
        for g in gaps:
            at += g
            y = letter[at : n - end + at]
            code, ok = code * LETTERS + y, ok & (y >= 0)
        ok &= owner[: n - end] == owner[end:]
        code = code[ok]
        found.append(code if len(gaps) == 2 else LETTERS**3 + (code * 2654435761 >> 7) % (CODES - LETTERS**3))
        weights.append(np.full(len(code), DECAY ** (end - len(gaps))))
        owners.append(owner[: n - end][ok])
    found, weights, owners = np.concatenate(found), np.concatenate(weights), np.concatenate(owners)
    norms = np.sqrt(np.maximum(np.bincount(owners, weights**2, minlength=len(words)), 1e-9))
    return found, weights, owners, norms


class Landmarks:
    """The landmarks' subsequences: ``place`` gives a code's row in ``dense`` or -1."""

    def __init__(self, words: list[str]):
        code, weight, owner, norm = runs(words)
        self.codes = np.unique(code)
        self.place = np.full(CODES, -1, np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        self.dense = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.dense, (self.place[code], owner), weight / norm[owner])

    def kernel(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): normalized kernel."""
        out = np.zeros((len(words), self.dense.shape[1]), np.float32)
        size = max(1, 20_000 // self.dense.shape[1])
        for s in range(0, len(words), size):
            part = words[s : s + size]
            code, weight, owner, norm = runs(part)
            row = self.place[code]
            known = row >= 0
            row, weight, owner = row[known], weight[known], owner[known]
            order = np.argsort(owner, kind="stable")
            row, weight, owner = row[order], weight[order], owner[order]
            some, first = np.unique(owner, return_index=True)
            if len(some):
                out[s + some] = np.add.reduceat(self.dense[row] * weight[:, None].astype(np.float32), first, axis=0) / norm[some, None]
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 100_000.0, rounds: int = 40) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the examples inside the margin; y is 1 or -1, classes weigh alike. The last column of x is the bias."""
    c = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum()))

    def loss(w: np.ndarray) -> float:
        return w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        inside = slack > 0
        part, weight = x[inside], c[inside]
        curve = np.eye(x.shape[1])
        for s in range(0, len(part), 1000):  # in double precision, in pieces
            some = part[s : s + 1000].astype(float)
            curve += 2 * some.T @ (some * weight[s : s + 1000, None])
        step = np.linalg.solve(curve, w - 2 * part.T @ (weight * y[inside] * slack[inside]))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, was = w - size * step, now
        now = loss(w)
        if now > was * (1 - 1e-6):
            break
    return w


@dataclass
class Model:
    """weights: one per run of letters; a text's value is the largest of its words', its score 1 / (1 + exp(-(slope * value + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float = 2.0
    shift: float = 0.0
    #: Left and right halves of toxic parts: of words cut in two, and of pairs; pairs of such words are looked at. A word that
    #: is like a pair's half, by the kernel, counts as one.
    halves: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
    pair_halves: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())

    def values(self, parts: list[str]) -> np.ndarray:
        out, start = [np.zeros(0, np.float32)], 0
        sizes = np.cumsum([len(w) + 8 for w in parts])
        while start < len(parts):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + AT_ONCE, side="right")))
            code, weight, owner, norm = runs(parts[start:stop])
            out.append((np.bincount(owner, self.weights[code] * weight, minlength=stop - start) / norm + self.bias).astype(np.float32))
            start = stop
        return np.concatenate(out)

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


class Scorer:
    """Texts' values, those of their worst parts, with a bounded memory of parts."""

    def __init__(self, model: Model):
        self.model = model
        self.like = [Landmarks(list(h)) for h in model.pair_halves] if model.pair_halves[0] else []
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, float] = {}
        self.halves = [set(h) for h in self.model.halves]

    def learn(self, parts: set[str]) -> None:
        new = list(parts - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self._forget()
            new = list(parts)
        if new:
            self.known.update(zip(new, self.model.values(new).tolist(), strict=True))
            for held, marks in zip(self.halves, self.like, strict=False):
                held.update(new[k] for k in np.flatnonzero(marks.kernel(new).max(axis=1) >= LIKE))

    def best(self, texts: list[str]) -> tuple[list[float], list[str]]:
        """Each text's value and the part that has it; of equal ones the first."""
        words = [words_of(t) for t in texts]
        sets = list(map(set, words))
        self.learn(set().union(*sets))
        left, right = self.halves
        pairs = [[] if left.isdisjoint(own) or right.isdisjoint(own) else [f"{a} {b}" for a, b in pairwise(ws) if a in left and b in right] for ws, own in zip(words, sets, strict=True)]
        more = {p for ps in pairs for p in ps}
        found = dict(zip(more, self.model.values(list(more)).tolist(), strict=True))
        get, none = self.known.__getitem__, ("", FLOOR)
        values, parts = [], []
        for ws, ps in zip(words, pairs, strict=True):
            w = max(ws, key=get, default=None)
            options = [none if w is None else (w, get(w)), *((p, found[p]) for p in ps)]
            part, value = max(options, key=lambda x: x[1])
            values.append(value)
            parts.append(part)
        return values, parts

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array(self.best(texts)[0])


def train(words: list[str], toxic: list[bool], landmarks: list[str]) -> Model:
    marks = Landmarks(landmarks)
    gram = marks.kernel(landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors * np.where(values > 1e-6 * values[-1], 1 / np.sqrt(np.maximum(values, 1e-12)), 0) @ vectors.T
    x = np.column_stack((marks.kernel(words) @ root.astype(np.float32), np.ones(len(words), np.float32)))
    w = fit_svm(x, np.where(toxic, 1.0, -1.0))
    weights = np.zeros(CODES, np.float32)
    weights[marks.codes] = marks.dense @ (root @ w[:-1])
    return Model(weights, float(w[-1]))


def spread(words: list[str], n: int) -> list[str]:
    """Up to n words, each time the one least like those taken."""
    if len(words) <= n:
        return words
    near, taken = Landmarks(words[:1]).kernel(words)[:, 0], [0]
    while len(taken) < n:
        near[taken] = 2
        k = int(near.argmin())
        if near[k] > 0.999:
            break
        taken.append(k)
        near = np.maximum(near, Landmarks(words[k : k + 1]).kernel(words)[:, 0])
    return [words[k] for k in taken]


def inserted(word: str) -> list[str]:
    """The word with one letter put in at each inner place, as a writer might to get past a filter."""
    return [word[:k] + "xzqkvj"[k % 6] + word[k:] for k in range(2, len(word) - 1)] if len(word) >= 5 else []


def halves_of(parts: list[str]) -> tuple[tuple[frozenset[str], frozenset[str]], tuple[tuple[str, ...], tuple[str, ...]]]:
    """Model.halves and Model.pair_halves of toxic parts."""
    cuts = [(w[:k], w[k:]) for w in parts if " " not in w for k in range(2, len(w) - 1)]
    pairs = [tuple(p.split(" ")) for p in parts if " " in p]
    both = [frozenset(c[k] for c in cuts + pairs) for k in (0, 1)]
    return (both[0], both[1]), (tuple(sorted({p[0] for p in pairs})), tuple(sorted({p[1] for p in pairs})))


def standing_out(counts: DataFrame, chance: float, total: int) -> DataFrame:
    """Of (part, clean, toxic) the parts that stand in toxic sentences more often than chance allows: by Chernoff's bound, over all parts."""
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(p / chance) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - chance))).otherwise(0)
    return counts.where((p > chance) & (gain > math.log(20 * max(total, 1))) & (F.col("toxic") > 4 * F.col("clean")))


def witnesses(sentences: DataFrame, scratch: Scratch) -> tuple[list[str], DataFrame] | None:
    """Toxic parts of sentences (text, toxic), and the table of all words (part, clean, toxic). None if either class is missing."""
    sizes = {r["toxic"]: r["count"] for r in sentences.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    chance = sizes[True] / (sizes[True] + sizes[False])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                by[bool(toxic)].update(set(words_of(text)))
            parts = list(by[0].keys() | by[1].keys())
            yield pd.DataFrame({"part": parts, "clean": [by[0][w] for w in parts], "toxic": [by[1][w] for w in parts]})

    def toxic_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(p for text in b["text"] for p in set(pairwise(words_of(text))))
            yield pd.DataFrame({"part": [" ".join(p) for p in n], "n": list(n.values())})

    def around(wanted: set[str]):
        """Copies with changes repeat a part between the same neighbours: of its places one per pair of neighbours counts."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = set()
                for text, toxic in zip(b["text"], b["toxic"], strict=True):
                    ws = ["", *words_of(text), ""]
                    found |= {(w, f"{x} {y}", bool(toxic)) for x, w, y in zip(ws, ws[1:], ws[2:], strict=False) if w in wanted}
                    found |= {(f"{w} {v}", f"{x} {y}", bool(toxic)) for x, w, v, y in zip(ws, ws[1:], ws[2:], ws[3:], strict=False) if f"{w} {v}" in wanted}
                yield pd.DataFrame(sorted(found), columns=["part", "around", "toxic"])

        places = sentences.mapInPandas(run, "part string, around string, toxic boolean").groupBy("part", "around").agg(F.min("toxic").alias("toxic"))
        return places.groupBy("part").agg(F.sum((~F.col("toxic")).cast("long")).alias("clean"), F.sum(F.col("toxic").cast("long")).alias("toxic"))

    counted = sentences.mapInPandas(words, "part string, clean long, toxic long").groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = scratch.write(counted, "words")
    total = counted.count()
    # what stands out is few: each such part needs several toxic sentences of its own in the bounded sample
    likely = {r["part"] for r in standing_out(counted, chance, total).select("part").collect()}
    pairs = sentences.where("toxic").select("text").mapInPandas(toxic_pairs, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    pairs = scratch.write(pairs, "pairs")
    n_pairs = pairs.count()
    least = math.ceil(math.log(20 * max(total + n_pairs, 1)) / math.log(1 / chance))  # fewer can't stand out, even if all are toxic
    may = {r["part"] for r in pairs.where(F.col("n") >= least).select("part").collect() if not likely & set(r["part"].split(" "))}
    apart = scratch.write(around(likely | may), "apart")
    toxic = [r["part"] for r in standing_out(apart, chance, total + n_pairs).orderBy(F.desc("toxic"), "part").collect()]
    return toxic, counted


def fit(docs: DataFrame, labels: DataFrame, seen, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled rows for which ``seen``, a function of the id Column, holds.

    A text with several labels counts as toxic if one says so. Null ids, labels and texts are left out. None if either class
    is missing or no part stands out, so too for empty tables.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & seen(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"))
    n = marked.count()
    if n > max_docs:
        marked = marked.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_003)) < int(1_000_003 * max_docs / n))
    # the sample's ids have a bound, max_docs, and so may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(marked), "id")
    rows = scratch.write(rows, "sample")
    # copies and near copies repeat their sentences: each counts once, and as harmless if it also stands in a harmless text
    sentences = rows.select("toxic", F.explode(F.split("text", SENTENCE)).alias("text")).where("text <> ''").groupBy("text").agg(F.min("toxic").alias("toxic"))
    found = witnesses(scratch.write(sentences, "sentences"), scratch)
    if not found or not found[0]:
        return None
    positive, harmless = found[0], found[1].where("clean > 0 AND clean >= toxic")
    negative = [r["part"] for r in harmless.orderBy(F.xxhash64("part"), "part").limit(NEGATIVES).collect()]
    hard = negative

    def trained() -> Model:
        more = [v for w in positive for v in inserted(w)]
        good = list(dict.fromkeys(positive[: LANDMARKS // 4] + spread(positive, LANDMARKS // 4)))
        model = train(positive + more + negative, [True] * (len(positive) + len(more)) + [False] * len(negative), good + spread(hard[:1500], LANDMARKS // 2))
        model.halves, model.pair_halves = halves_of(positive)
        return model

    model = trained()
    for _ in range(ROUNDS):
        rated = append(rows, "text", "value double, part string", lambda m=model: Scorer(m).best)
        rated = rated.groupBy("part").agg(F.sum((~F.col("toxic")).cast("long")).alias("clean"), F.sum(F.col("toxic").cast("long")).alias("toxic"), F.max("value").alias("value"))
        own = rated.where("part <> ''").orderBy(F.desc("value"), "part").collect()  # at most a row a text of the sample
        hard = [r["part"] for r in own if r["clean"] and r["clean"] >= r["toxic"]]
        negative = list(dict.fromkeys(hard + negative))
        positive += [r["part"] for r in own if r["toxic"] >= 3 and r["toxic"] > 4 * r["clean"] and r["value"] > 0 and r["part"] not in set(positive)]
        model = trained()

    held = append(rows, "text", "value double", lambda m=model: lambda texts, s=Scorer(m): (s(texts).tolist(),)).select("toxic", "value").toPandas()
    value, y = held["value"].to_numpy(), held["toxic"].to_numpy(dtype=float)
    a, b = 2.0, 0.0
    for _ in range(50):  # Newton steps with a slight pull to the start keep the curve finite when the classes separate
        q = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        g = np.array([((q - y) * value).sum() + 0.01 * (a - 2), (q - y).sum() + 0.01 * b])
        h = (q * (1 - q))[:, None, None] * np.stack([np.stack([value**2, value]), np.stack([value, np.ones_like(value)])]).transpose(2, 0, 1)
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h.sum(axis=0) + 0.01 * np.eye(2), g), -2, 2)
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with score double (0 to 1) and predicted int. A null or empty text scores as one without a word; without a model all score 0.

    Rows keep their other columns, null or repeated ones too; columns named score or predicted are replaced. An empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        if sent.value is None:
            return lambda texts: ([0.0] * len(texts), [0] * len(texts))
        scorer = Scorer(sent.value)

        def run(texts):
            s = sent.value.score(scorer(texts))
            return s.tolist(), (s >= 0.5).astype(int).tolist()

        return run

    return append(docs, text_col, "score double, predicted int", make)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, learned from labels of documents that aren't held out; a null id is neither
    learned from nor held out. Documents without a text, or with repeated ids, have rows as any other; empty tables give an empty result."""
    model = fit(docs, labels, lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(5)) != 0)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
