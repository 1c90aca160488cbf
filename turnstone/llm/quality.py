"""Quality rules: base counts, and how far a text's histograms are from its language's.

Two histograms of a text, of character classes and of common words, are compared with references by the Jensen-Shannon
distance (root of the divergence in bits, 0 to 1). The references are the sums of the same counts over all documents of a
language, a few hundred numbers per language; its common words are learned from the same documents, as those that make up a
given share of its words. The language nearest to the text decides, so no label of the text is used. As
short texts scatter, the classes have a least length below which they say nothing, and the bound of the words' distance has a
term for that noise, which falls with the root of the number of words.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.scratch import prepare
from turnstone.llm.texts import append

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  #: percent of words
CLASS_LENGTH, WORD_LENGTH = 200, LEAST_WORDS  #: least characters and words for the two comparisons
CLASS_DISTANCE, WORD_DISTANCE, WORD_NOISE = 0.28, 0.18, 1.3  #: greater distances fail; see word_bound

COMMON_SHARE = 1 / 400  #: a word is common in a language of whose words it makes up this share; so there are at most 400
REFERENCE_WORDS = 1_000  #: a language with fewer words in all documents has no reference
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte: lower case, upper case, digit, white space, sentence marks, other ASCII, first byte of other characters; continuation bytes are none."""
    table = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b, 6] = 1
        elif b < 0x80:
            table[b, 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:!?'\"()-" else 5] = 1
    return table


CLASSES = _classes()
#: Words are compared with marks cut off and A-Z in lower case.
_PLAIN = bytes(ord(" ") if chr(b) in ".,;:!?\"()|" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES


@dataclass
class References:
    """languages; classes (K, 7), shares; words: number of every common word; own (K, n): numbers of each language's, -1 for none; common (K, n + 1): their shares, and that of all others."""

    languages: list[str]
    classes: np.ndarray
    words: dict[bytes, int]
    own: np.ndarray
    common: np.ndarray

    def word_distance(self, data: bytes, n_words: int) -> float:
        """To the nearest language."""
        found = np.fromiter((k for k in map(self.words.get, plain_words(data)) if k is not None), np.int64)
        counts = np.append(np.bincount(found, minlength=len(self.words)), 0)[self.own] / n_words
        rest = np.maximum(1 - counts.sum(axis=1, keepdims=True), 0)
        p = np.concatenate((counts, rest), axis=1)
        return float(js_distance(p / p.sum(axis=1, keepdims=True), self.common).min())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a distribution p (n), or of each row of p (k, n), to each row of q (k, n)."""
    p = np.atleast_2d(p)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        return np.sqrt(np.clip((kl(np.broadcast_to(p, q.shape)) + kl(q)) / 2, 0, 1))


def word_bound(n_words: int) -> float:
    """The greatest word distance that a text of so many words may have."""
    return WORD_DISTANCE + WORD_NOISE / n_words**0.5


def doubled(same: np.ndarray) -> np.ndarray:
    """Which entries of a sorted list equal a neighbour; ``same`` says it of each and the one before."""
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


class Counter:
    """Base counts and histograms of texts. Words are numbered; numbers hold within a call."""

    def __init__(self, most: int = 500_000):
        class Numbers(dict):
            def __missing__(self, w):
                self[w] = k = len(self)
                return k

        self.numbers, self.most = Numbers(), most

    def base(self, texts: list[str]) -> tuple[list[bytes], list[list[bytes]], np.ndarray]:
        """Encoded texts, their words and (texts, 5) counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        if len(self.numbers) > self.most:
            self.numbers.clear()
        data = [t.encode("utf-8", "replace") for t in texts]
        words = [d.split() for d in data]
        get = self.numbers.__getitem__
        out = np.zeros((len(texts), 5), np.int64)
        out[:, 0] = [len(w) for w in words]
        for i, (t, d) in enumerate(zip(texts, data, strict=True)):
            seen = np.bincount(np.frombuffer(d, np.uint8), minlength=256)
            out[i, 1] = len(t) - seen[9:14].sum() - seen[32]
            out[i, 2] = seen[_SYMBOLS].sum()
            if seen[10]:
                lines = [x for x in d.split(b"\n") if x and not x.isspace()]
                out[i, 3] = len(lines) - len(set(lines))
        flat = np.array([get(w) for ws in words for w in ws], dtype=np.uint64)
        if len(flat) >= WINDOW:
            owner = np.repeat(np.arange(len(texts)), out[:, 0])
            h, n = flat + np.uint64(1), len(flat) - WINDOW + 1
            for step, power in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
                h = (h[:-step] * np.uint64(power)) ^ (h[:-step] >> np.uint64(29)) ^ ((h[step:] << np.uint64(23)) | (h[step:] >> np.uint64(41)))
            h = (h + owner[:n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
            order = inside[np.argsort(h[inside], kind="stable")]
            order = order[doubled(h[order][1:] == h[order][:-1])[: len(order)]]  # then the words themselves decide
            columns = [owner[order], *(flat[order + j] for j in range(WINDOW))]
            by_word = np.lexsort(columns) if len(order) else order
            order, columns = order[by_word], [c[by_word] for c in columns]
            starts = order[doubled(np.all([c[1:] == c[:-1] for c in columns], axis=0))] if len(order) else order
            twice = np.zeros(len(flat) + 1, np.int64)
            np.add.at(twice, starts, 1)
            np.add.at(twice, np.minimum(starts + WINDOW, len(flat)), -1)
            out[:, 4] = np.bincount(owner[np.cumsum(twice)[:-1] > 0], minlength=len(texts))
        return data, words, out


def labelled(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")


def candidates(rows: DataFrame, share: float) -> list[tuple[str, bytes]]:
    """(language, word) of all words that may have the share: one that has it in all documents has it in those of some task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Tally] = {}
        size = 0

        def out() -> pd.DataFrame:
            found = [(lang, w) for lang, t in held.items() for bound in [share * t.total()] for w, n in t.items() if n >= bound]
            return pd.DataFrame(found, columns=["lang", "word"])

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                held.setdefault(lang, Tally()).update(plain_words(text.encode("utf-8", "replace")))
            if (size := sum(map(len, held.values()))) > 500_000:  # the words of a part of the task's documents, for which the same holds
                yield out()
                held.clear()
        if size:
            yield out()

    found = rows.mapInPandas(run, "lang string, word binary").distinct().collect()  # at most 1 / share words a language, task and part
    return sorted((r["lang"], bytes(r["word"])) for r in found if bytes(r["word"]).decode("utf-8", "replace").isalpha())


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = COMMON_SHARE, least: int = REFERENCE_WORDS) -> References | None:
    """Shares over all documents of each language that is not null. Rows with a null text or language count nowhere; no language with ``least`` words: None."""
    prepare(docs.sparkSession)
    rows = labelled(docs, text_col, lang_col)
    may = candidates(rows, share)
    words = {w: k for k, w in enumerate(sorted({w for _, w in may}))}
    bins = 8 + len(words)  # classes, number of words, words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                data = text.encode("utf-8", "replace")
                s = sums.setdefault(lang, np.zeros(bins))
                s[:7] += class_counts(data)
                s[7] += len(data.split())
                s[8:] += np.bincount(np.fromiter((k for k in map(words.get, plain_words(data)) if k is not None), np.int64), minlength=len(words))
        for lang, s in sums.items():
            some = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "bin": some, "n": s[some]})

    summed = rows.mapInPandas(run, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    enough = summed.where(f"bin = 7 AND n >= {least}").select("lang")
    got = summed.join(enough, "lang", "left_semi").toPandas()  # languages with a reference x bins
    table = {lang: np.zeros(bins) for lang in sorted(got["lang"].unique())}
    for lang, g in got.groupby("lang"):
        table[lang][g["bin"].to_numpy()] = g["n"]
    if not table:
        return None
    own = [[words[w] for lang, w in may if lang == name and s[8 + words[w]] >= share * s[7]] for name, s in table.items()]
    n = max(map(len, own))
    numbers = np.array([o + [len(words)] * (n - len(o)) for o in own], np.int64).reshape(len(own), n)  # the last place holds nothing
    common = np.array([np.append(s[8:], 0)[o] / s[7] for s, o in zip(table.values(), numbers, strict=True)])
    common = np.concatenate((common, np.maximum(1 - common.sum(axis=1, keepdims=True), 0)), axis=1)
    classes = np.array([s[:7] / s[:7].sum() for s in table.values()])
    return References(list(table), classes, words, numbers, common / common.sum(axis=1, keepdims=True))


def judge(docs: DataFrame, known: References | None, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, class_distance, word_distance (double), kept.

    A null text has no word and fails. A distance is null where the text is too short for it or there is no reference; then it
    doesn't count against the text. Rows keep their other columns, null or repeated ones too; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        counter, known = Counter(), sent.value

        def run(texts):
            data, _, base = counter.base(texts)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            far_c, far_w = [None] * len(texts), [None] * len(texts)
            for i, (d, n) in enumerate(zip(data, base[:, 0].tolist(), strict=True)):
                if known and len(texts[i]) >= CLASS_LENGTH:
                    h = class_counts(d)
                    far_c[i] = float(js_distance(h / h.sum(), known.classes).min())
                if known and n >= WORD_LENGTH:
                    far_w[i] = known.word_distance(d, n)
            kept = [not f and (c is None or c <= CLASS_DISTANCE) and (w is None or w <= word_bound(n)) for f, c, w, n in zip(failed, far_c, far_w, base[:, 0].tolist(), strict=True)]
            return (*base.T.tolist(), failed.tolist(), far_c, far_w, kept)

        return run

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return append(docs, text_col, fields, make)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts, distances and verdict of ``judge`` for every document, held against references of all documents."""
    return judge(docs.select("doc_id", "text"), references(docs)).drop("text")
