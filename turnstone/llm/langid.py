"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

A word's scores are naive Bayes over hashed character n-grams (two to four characters, word ends marked) and the whole
word. The scripts of a word's letters leave only languages that are written in them. Over a text's words the best path
pays a penalty for each change of language; its runs are the language spans, and the language that holds most letters is
the text's. A worker remembers words' scores, up to a bound, and new words are scored together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.scratch import prepare
from turnstone.llm.texts import append


BUCKETS = 1 << 16
TRAIN_DOCS = 20_000  #: expected number of labelled documents in the sample that the model is fitted on
LANGUAGES = 512  #: the most frequent labels of that sample are learned, ties by name; bounds the model, which has BUCKETS numbers for each
PENALTY = 6.0  #: nats that a change of language costs
CACHE = 200_000
BATCH_WORDS = 1_000_000  #: words of short texts that go through Viterbi together
EXCLUDED = -30.0  #: score of a language that isn't written in the word's script
UNDETERMINED = "und"

#: First and last code points of scripts' main blocks (fixed values of Unicode), in order; letters elsewhere count as "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(s[0] for s in SCRIPTS), "other"]
_FIRSTS = np.array([s[1] for s in SCRIPTS])
_LASTS = np.array([s[2] for s in SCRIPTS])
_IDS = np.array([NAMES.index(s[0]) for s in SCRIPTS])

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall(text.lower())


def script_of(codes: np.ndarray) -> np.ndarray:
    """Script number of each letter."""
    k = np.maximum(np.searchsorted(_FIRSTS, codes, side="right") - 1, 0)
    return np.where((codes >= _FIRSTS[k]) & (codes <= _LASTS[k]), _IDS[k], len(NAMES) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).astype(np.uint64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, the word each belongs to, each word's length and the script of its first letter."""
    line = ("\x02" + "\x03\x02".join(words) + "\x03") if words else ""
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    lengths = np.diff(np.append(starts, len(codes)))  # with both marks
    owner = np.repeat(np.arange(len(words)), lengths)
    h, parts, owners = codes + np.uint64(7), [], []
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(1_000_003) + codes[n - 1 :] if len(h) else h
        inside = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
        parts.append(mix(h[inside] + np.uint64(n)))
        owners.append(owner[: len(h)][inside])
    whole = np.zeros(len(words), np.uint64)
    power = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    np.add.at(whole, owner, mix(codes * np.uint64(0x100000001B3) + power))
    parts.append(mix(whole))
    owners.append(np.arange(len(words)))
    buckets = (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(owners), lengths - 2, script_of(codes[starts + 1]) if words else np.zeros(0, int)


@dataclass
class Model:
    """languages; weights (BUCKETS, K) of log-likelihoods; allowed (scripts, K): languages written in a script."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, K): mean log-likelihood per feature times the root of the number of features, so that n-grams that overlap don't count in full."""
        buckets, owner, _, script = features(words)
        order = np.argsort(owner, kind="stable")
        total = np.add.reduceat(self.weights[buckets[order]], np.searchsorted(owner[order], np.arange(len(words))), axis=0)
        n = np.bincount(owner, minlength=len(words))
        total = total / np.sqrt(n)[:, None]
        total -= total.max(axis=1, keepdims=True)
        return np.where(self.allowed[script], total, total + EXCLUDED).astype(np.float32)


def fit(docs: DataFrame, learn, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_languages: int = LANGUAGES) -> Model | None:
    """Counts over a bounded sample of the rows for which ``learn`` (a Column) holds and the label isn't null.

    Only text and label enter the model; the sample is drawn by a hash of the id, of about ``max_docs`` rows, and the
    ``max_languages`` labels that most of its rows have are learned. No such row, or no letter in them: None.
    """
    prepare(docs.sparkSession)
    known = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    n = known.select("label").count()
    if not n:
        return None
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_003)) < int(1_000_003 * max_docs / n))
    top = [r["label"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_languages).collect()]
    known = known.where(F.col("label").isin(top))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["label"], b["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                buckets, _, lengths, script = features(words)
                grams.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(buckets, minlength=BUCKETS)
                scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))[:] += np.bincount(script, weights=lengths, minlength=len(NAMES)).astype(np.int64)
        for lang in grams:
            both = np.concatenate((grams[lang], scripts[lang]))
            some = np.flatnonzero(both)
            yield pd.DataFrame({"label": lang, "bucket": some, "n": both[some]})

    def packed(g: pd.DataFrame) -> pd.DataFrame:  # a row a label, of at most BUCKETS + scripts numbers
        return pd.DataFrame({"label": [g["label"].iloc[0]], "buckets": [g["bucket"].to_numpy(np.int32).tobytes()], "ns": [g["n"].to_numpy(np.int64).tobytes()]})

    counted = known.select("label", "text").mapInPandas(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    got = counted.groupBy("label").applyInPandas(packed, "label string, buckets binary, ns binary").collect()  # at most max_languages rows
    if not got:
        return None
    languages = sorted(r["label"] for r in got)
    table = np.zeros((BUCKETS + len(NAMES), len(languages)), np.float32)
    for r in got:
        table[np.frombuffer(r["buckets"], np.int32), languages.index(r["label"])] = np.frombuffer(r["ns"], np.int64)
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS))
    allowed = scripts > 0.01 * scripts.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True  # a script of no learned language: every language stays
    return Model(languages, (weights - weights.mean(axis=1, keepdims=True)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best states of all words. scores (words, K); text t has lengths[t] >= 1 words from starts[t].

    All texts step together, longest first, so a step is one array operation over the texts that still have words.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # texts with more than t words
    best = np.zeros((len(n), k), np.float32)
    back = np.full(scores.shape, -1, np.int32)  # -1: no change of language
    for t in range(n[0]):
        m = live[t]
        at = s[:m] + t
        if t:
            b = best[:m]
            top = b.argmax(axis=1)
            other = b[np.arange(m), top][:, None] - np.float32(penalty)
            switch = other > b
            back[at] = np.where(switch, top[:, None], -1)
            best[:m] = np.where(switch, other, b)
        best[:m] += scores[at]
    path = np.zeros(len(scores), np.int32)
    state = np.zeros(len(n), np.int64)
    for t in range(n[0] - 1, -1, -1):
        m = live[t]
        at = s[:m] + t
        ends = n[:m] == t + 1
        state[:m][ends] = best[:m][ends].argmax(axis=1)
        path[at] = state[:m]
        came = back[at, state[:m]]
        state[:m] = np.where(came >= 0, came, state[:m])
    return path


class Labeller:
    """Labels texts' words and sums them up, with a bounded memory of words."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.table = np.concatenate((self.table, self.model.scores(new)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, new), np.int32, len(new))))

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(path, letters, starts, lengths): the language number and the letters of every word, and where each text's words are."""
        scores, sizes, lengths = [], [], []
        for i in range(0, len(texts), 64):
            words = [words_of(t) for t in texts[i : i + 64]]
            new = list(set().union(*words) - self.ids.keys())
            if len(self.ids) + len(new) > CACHE:
                self._forget()
                new = list(set().union(*words))
            self._learn(new)
            flat = np.array([self.ids[w] for ws in words for w in ws], dtype=np.int64)
            scores.append(self.table[flat])
            sizes.append(self.sizes[flat])
            lengths += map(len, words)
        lengths = np.array(lengths, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        scores, some = np.concatenate(scores), lengths > 0
        path = viterbi(scores, starts[some], lengths[some], self.penalty) if some.any() else np.zeros(0, np.int32)
        return path, np.concatenate(sizes), starts, lengths

    def groups(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of texts of bounded size."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t) // 5 + 1
            if size >= BATCH_WORDS:
                yield start, i + 1
                start, size = i + 1, 0
        if start < len(texts):
            yield start, len(texts)

    def spans(self, texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
        """For each text (first word, word after the last, language), in order."""
        for a, b in self.groups(texts):
            path, _, starts, lengths = self.paths(texts[a:b])
            for s, n in zip(starts, lengths, strict=True):
                own = path[s : s + n]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
                yield [(int(x), int(y), self.model.languages[own[x]]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Each text's language, the one with most letters on its path, and its share of the letters; no letter: undetermined, 0."""
        langs, shares, k = [], [], len(self.model.languages)
        for a, b in self.groups(texts):
            path, sizes, starts, lengths = self.paths(texts[a:b])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            held = np.bincount(owner * k + path, weights=sizes, minlength=len(lengths) * k).reshape(-1, k)
            top, total = held.argmax(axis=1), held.sum(axis=1)
            langs += [self.model.languages[t] if n else UNDETERMINED for t, n in zip(top, total, strict=True)]
            shares += (held[np.arange(len(held)), top] / np.maximum(total, 1)).tolist()
        return langs, shares


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def seen(id_col: str = "doc_id"):
    """Rows to learn from; a null id belongs to neither side."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Rows of docs with lang_pred string and score double (the share of the text's letters that the language holds).

    A null text, one without a letter, or no model: ``und`` with score 0. Rows keep their other columns, null or repeated
    ones too; columns named lang_pred or score are replaced. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return Labeller(sent.value, penalty).label if sent.value else lambda texts: ([UNDETERMINED] * len(texts), [0.0] * len(texts))

    return append(docs, text_col, "lang_pred string, score double", make, 4096)


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per language span: id, first_word, end_word (numbers of letter runs), lang."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value, penalty)
        for b in batches:
            found = [(i, *s) for i, spans in zip(b["id"], labeller.spans([t or "" for t in b["text"]]), strict=True) for s in spans]
            yield pd.DataFrame(found, columns=[id_col, "first_word", "end_word", "lang"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, first_word long, end_word long, lang string")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from those that aren't held out."""
    model = fit(docs, seen())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows that have no language or none with at least ``least`` of the letters; all columns stay."""
    model = fit(docs, seen())
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))  # so no column of docs can clash
    kept = identify(rows, model, "_text").where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select("_row.*")
