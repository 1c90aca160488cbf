"""Best-fit packing of token sequences, online and with bounded space.

Texts are encoded whole. A packer takes the pieces as they come and holds a fixed number of open bins in a bitset keyed by
free space: a piece goes to the open bin with the least room that still fits it; when too many bins are open the fullest
closes. Packers run over disjoint parts of the pieces. What stands in bins that are open at a part's end is packed again over
ever fewer parts, down to one, so parts cost no sequences.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstone.llm.bpe import byte_letters
from turnstone.llm.scratch import Scratch
from turnstone.llm.texts import append

LENGTH = 2048
OPEN = 1024  #: open bins of a packer
PART_TOKENS = LENGTH * 16_384  #: tokens for which one part is used
PART_ROWS = 500_000  #: pieces for which one part is used, as a part's places are held until its open bins are known
FAN_IN = 16  #: parts whose open bins are packed again together
#: The pattern of byte-level BPE, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    """Ids of whole texts as the bytes of little-endian unsigned 32-bit numbers, equal to those of the tokenizers library for the file.

    Where the file's merges are in the order of the ids they make, as byte-level vocabularies usually are, the merge ranks
    are the ids, and the faster encoder that takes ranks gives the same ids; any other file is left to the library itself. So
    is a text that the faster one refuses: its pattern backtracks, and runs out of room on a very long run of white space.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        made = [vocab[m] for m in merged]
        plain = spec["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and not spec.get("normalizer") and made == sorted(made) and vocab.keys() - special.keys() == {*letters, *merged}:
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            self.coder = None
        self.path, self.other = path, None

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.coder:
            return self._library(texts)
        out = []
        for t in texts:
            try:
                out.append(self.coder.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes())
            except ValueError:
                out += self._library([t])
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        if not self.other:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(self.path)
            self.other.no_truncation()
            self.other.no_padding()
        return [array("I", e.ids).tobytes() for e in self.other.encode_batch_fast(texts, add_special_tokens=False)]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first of several may be shorter."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts' ids, each text closed by ``end_id``: id, piece int, start long, length long, ids_crc32 long.

    A null or empty text is one piece that holds the end alone. Ids may be null or repeat; other columns are ignored.
    """

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = TextEncoder(path), array("I", [end_id]).tobytes()

        def pieces(data: bytes) -> list[tuple[int, int, int, int]]:
            data += end
            return [(k, a, n, zlib.crc32(data[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(data) // 4, length))]

        return lambda texts: (list(map(pieces, coder.encode(texts))),)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    cuts = append(rows, "_text", "_p array<struct<piece:int,start:long,length:long,ids_crc32:long>>", make)
    return cuts.select(id_col, F.explode("_p").alias("_p")).select(id_col, "_p.*")


class Packer:
    """Online best fit with at most ``limit`` open bins. ``place`` returns (bin, offset); ``open_bins`` are those not closed."""

    def __init__(self, length: int = LENGTH, limit: int = OPEN):
        self.length, self.limit, self.count, self.n_open = length, limit, 0, 0
        self.bits = 0  # bit f is set if an open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.length, self.count
            self.count += 1
            self.n_open += 1
        left = free - size
        if left:
            self.by_free[left].append(name)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        if self.n_open > self.limit:  # the fullest closes
            self._take((self.bits & -self.bits).bit_length() - 1)
            self.n_open -= 1
        return name, self.length - free

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        name = held.pop()
        if not held:
            self.bits ^= 1 << free
        return name

    def open_bins(self) -> set[int]:
        return {name for held in self.by_free for name in held}


def pack(pieces: DataFrame, length: int = LENGTH, limit: int = OPEN, part_tokens: int = PART_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces with sequence_id long and offset long: every row gets a place in a sequence of at most ``length``, gapless from 0.

    pieces must have a column length of 1..``length``; its other columns stay, null and repeated ones too. An empty table
    gives an empty result. Columns named sequence_id or offset are replaced.
    """
    scratch, own = Scratch(pieces.sparkSession, "pack"), pieces.drop("sequence_id", "offset")
    rest = scratch.write(own.select(F.struct("*").alias("_piece"), F.col("length").cast("int").alias("_n"), F.monotonically_increasing_id().alias("_row")), "pieces")
    total, rows = rest.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    parts, level, done = max(1, math.ceil(total / part_tokens), math.ceil(rows / part_rows)), 0, []

    def packed(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = (level << 58) | (TaskContext.get().partitionId() << 34)
            packer, held = Packer(length, limit), []

            def placed(b: pa.RecordBatch, spots: list[tuple[int, int]], still: set[int]) -> pa.RecordBatch:
                more = [pa.array([base | n for n, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64()), pa.array([n in still for n, _ in spots], pa.bool_())]
                return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "sequence_id", "offset", "open"])

            for b in batches:
                spots = [packer.place(n) for n in b["_n"].to_pylist()]
                if last:
                    yield placed(b, spots, set())
                else:  # the rows leave once the part's open bins are known
                    held.append((b, spots))
            still = packer.open_bins()
            for b, spots in held:
                yield placed(b, spots, still)

        return run

    schema = StructType([*rest.schema.fields, *StructType.fromDDL("sequence_id long, offset long, open boolean").fields])
    while True:
        dealt = rest.repartition(parts, "_row").sortWithinPartitions("_row")  # so that a task that runs again sees the same order
        out = scratch.write(dealt.mapInArrow(packed(level, parts == 1), schema), f"level-{level}")
        done.append(out.where("NOT open"))
        if parts == 1:
            break
        rest, parts, level = out.where("open").select(rest.columns), math.ceil(parts / FAN_IN), level + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("_piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, cut those of more than ``length`` tokens, and pack the pieces; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, path, length, end_id, id_col, text_col), length)
