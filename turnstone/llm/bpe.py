"""Byte-pair encoding and decoding with a published vocabulary file.

One pre-token is encoded by a priority queue of merge ranks over a doubly linked list of symbols; entries whose symbols
have changed since are skipped when they come up. Pre-tokens repeat, so each worker keeps what it has encoded, up to a
bound. Decoding joins the vocabulary's strings. Where Unicode versions may differ in case, class or composition, a word is
normalized and cut by the tokenizers library, so its tables decide.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cache

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from turnstone.llm.texts import append

#: Unicode's White_Space; str.split also splits at the four separators U+001C to U+001F, which aren't in it.
SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Words of these alone are normalized and cut here: precomposed letters that NFC leaves as they are, and on whose case and class
#: all Unicode versions agree. Other words go through the library's own normalizer and pre-tokenizer, so its version decides.
PLAIN = regex.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]*")

CACHE = 500_000  #: words, and pre-tokens, that a worker remembers; when full it starts anew


def split(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stays, the rest is numbered from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class Bpe:
    """Reads a tokenizers JSON file whose model is byte-level BPE. Supported: normalizers NFC, Lowercase and white-space
    replacement; one Split pattern or the byte-level pattern; added tokens, which are found in the raw text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.size = max(self.vocab.values()) + 1
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.suffix = model.get("end_of_word_suffix") or ""
        if any(t.get(f) for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be found in the raw text as they stand")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)  # its normalizer and pre-tokenizer only; merges and decoding are done here
        self.bytes = [self.vocab.get(c, -1) for c in self.letters]
        self.ends = [self.vocab.get(c + self.suffix, -1) for c in self.letters]
        self.steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if unknown := set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers that are not supported: {sorted(unknown)}")
        splits = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if len(splits) != 1:
            raise ValueError("the file must have one Split pattern")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.written: dict[str, tuple[int, str, str]] = {}

    def cut(self, word: str) -> list[bytes]:
        """Pre-tokens of a text without white space. White-space replacement changes none, as patterns take no white space."""
        if PLAIN.fullmatch(word):
            return [p.encode() for p in self.pattern.findall(word.lower() if "Lowercase" in self.steps else word)]
        word = self.library.normalizer.normalize_str(word) if self.steps else word
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one pre-token's symbols, given as ids. A queue entry is rank and place in one number; a symbol that has gone is -1."""
        n, size, rank, made = len(symbols), self.size, self.ranks.get, self.made
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] * size + symbols[i + 1])) is not None]
        if not queue:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        while queue:
            e = pop(queue)
            r, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if j >= n or rank(symbols[i] * size + symbols[j]) != r:  # stale: one of the two has grown or gone since
                continue
            new = symbols[i] = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new * size + symbols[k])) is not None:
                    push(queue, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank(symbols[k] * size + new)) is not None:
                push(queue, r << 32 | k)
        return [s for s in symbols if s >= 0]

    def pre_token(self, data: bytes) -> list[int]:
        if (ids := self.pieces.get(data)) is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            symbols = [self.bytes[b] for b in data]
            symbols[-1] = self.ends[data[-1]]
            if -1 in symbols:  # the vocabulary lacks a byte: it can't be encoded and is left out
                symbols = [s for s in symbols if s >= 0]
            ids = self.pieces[data] = self.merge(symbols)
        return ids

    def fresh(self, word: str) -> list[int]:
        """Ids of a text without white space and without added tokens."""
        if word.isascii() and word.isalpha():  # one pre-token
            return self.pre_token((word.lower() if "Lowercase" in self.steps else word).encode())
        return [i for piece in self.cut(word) for i in self.pre_token(piece)]

    def word(self, word: str) -> list[int]:
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self.words[word] = self.fresh(word)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens added; an added token's string in the text is that token."""
        ids: list[int] = []
        at, text = 0, text or ""
        for m in self.special.finditer(text) if self.special else ():
            for w in split(text[at : m.start()]):
                ids += self.word(w)
            ids.append(self.added[m[0]])
            at = m.end()
        for w in split(text[at:]):
            ids += self.word(w)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings: joined and read as bytes with a byte-level decoder, else joined by spaces as they stand."""
        names = [self.names[i] for i in ids if i in self.names]
        if not self.byte_level_decoder:
            return " ".join(names)
        byte = self.byte_of
        return bytes(b for s in names for b in (map(byte.__getitem__, s) if all(c in byte for c in s) else s.encode())).decode("utf-8", "replace")


@cache
def coder(path: str) -> Bpe:
    """The worker's coder for a file; it lives as long as the worker, so later tasks find the words of earlier ones."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int> of every whole text; a null or empty text has none.

    Needs ``path`` on every executor. Rows keep their other columns, null and repeated ones too; a column named ids is
    replaced. An empty table gives an empty result.
    """

    def make():
        bpe = coder(path)
        return lambda texts: ([bpe.encode(t) for t in texts],)

    return append(docs, text_col, "ids array<int>", make)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column text, decoded from arrays of ids; null ids give an empty text."""

    def make():
        bpe = coder(path)
        return lambda ids: ([bpe.decode(x) for x in ids],)

    return append(rows, ids_col, "text string", make)


def round_trip_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens long, ids_sha256 (decimal ids joined by a space) and decoded_sha256, of each whole text encoded and then decoded.

    The same encoder and decoder as ``encode`` and ``decode``; a word's ids and decoded text are kept as written strings.
    Cases as in ``encode``; no ids: the digests of the empty text.
    """

    def make():
        bpe = coder(path)
        plain = not bpe.byte_level_decoder  # then a text decodes word by word
        kept = bpe.written

        def word(w: str) -> tuple[int, str, str]:
            ids = bpe.fresh(w)
            if len(kept) >= CACHE:
                kept.clear()
            kept[w] = found = (len(ids), " ".join(map(str, ids)), bpe.decode(ids) if plain else "")
            return found

        def digests(text: str) -> tuple[int, str, str]:
            if plain and not (bpe.special and bpe.special.search(text)):
                found = [x for x in (kept.get(w) or word(w) for w in split(text)) if x[0]]
                n, ids, back = sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
            else:
                every = bpe.encode(text)
                n, ids, back = len(every), " ".join(map(str, every)), bpe.decode(every)
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()

        return lambda texts: tuple(zip(*map(digests, texts), strict=True))

    return append(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
