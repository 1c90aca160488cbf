"""Units of literary editions, as spans of code points over one text, and the speech in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.shipping import ship

UNIT = "source string, unit_id string, episode_id string, kind string, start int, stop int"
MOST_TAG = 80  #: code points that a speech tag between two parts of one quotation may have (fixed value)


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower().replace("'", "")).strip("-")


def body(text: str) -> tuple[int, int]:
    """Where the edition's text stands between its START and END marks; without marks, all of it."""
    a, b = re.search(r"\*\*\* ?START OF[^\n]*\n", text), re.search(r"\*\*\* ?END OF", text)
    return (a.end() if a else 0), (b.start() if b else len(text))


def trim(text: str, start: int, stop: int) -> tuple[int, int]:
    part = text[start:stop]
    return start + len(part) - len(part.lstrip()), start + len(part.rstrip())


def fables(source: str, text: str) -> list[tuple]:
    """A title is a line in capitals after three blank lines or more; below it each paragraph is narrative, or a moral where all its lines are indented."""
    lo, hi = body(text)
    title = re.compile(r"(?:^|(?:[ \t]*\r?\n){4,})[ \t]*((?=[^a-z\r\n]*[A-Z])[^a-z\r\n]+?)[ \t]*\r?\n")
    heads = list(title.finditer(text, lo, hi))
    units: list[tuple] = []
    for k, m in enumerate(heads):
        episode = f"aesop:{slug(m[1])}"
        units.append((source, f"{episode}:title", episode, "title", *trim(text, *m.span(1))))
        stop = heads[k + 1].start() if k + 1 < len(heads) else hi
        for n, p in enumerate(re.finditer(r"(?:[^\r\n]*\S[^\r\n]*(?:\r?\n|$))+", text[m.end() : stop]), 1):
            lines = [x for x in p[0].splitlines() if x.strip()]
            kind = "moral" if all(x[0].isspace() for x in lines) else "narrative"
            units.append((source, f"{episode}:p{n}", episode, kind, *trim(text, m.end() + p.start(), m.end() + p.end())))
    return units


def verses(source: str, text: str, book: str) -> list[tuple]:
    """Verses of one book by their chapter:verse marks, which must follow one another; a separator line ends a verse."""
    lo, hi = body(text)
    marks = list(re.finditer(r"(?<!\S)(\d{1,3}):(\d{1,3})(?!\S)", text[lo:hi]))
    stops = [lo + m.start() for m in re.finditer(r"(?m)^[^\w\n]*\S[^\w\n]*$", text[lo:hi])]
    units, last = [], None
    for k, m in enumerate(marks):
        at = (int(m[1]), int(m[2]))
        if at != (1, 1) if last is None else at not in ((last[0], last[1] + 1), (last[0] + 1, 1)):
            raise ValueError(f"{book} {at[0]}:{at[1]} is out of order")
        last = at
        start, stop = lo + m.end(), lo + marks[k + 1].start() if k + 1 < len(marks) else hi
        stop = min([stop, *(s for s in stops if s > start)])
        episode = f"kjv:{slug(book)}:{at[0]}"
        units.append((source, f"{episode}:{at[1]}", episode, "verse", *trim(text, start, stop)))
    return units


PARSERS = {"fables": lambda r: fables(r.source, r.text), "verses": lambda r: verses(r.source, r.text, r.book)}


def units(editions: DataFrame, parser: str) -> DataFrame:
    """editions: (source, text, book) to one row a unit, by the named parser; a parser needs the whole of a text at once."""
    ship(editions.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame(PARSERS[parser](r), columns=["source", "unit_id", "episode_id", "kind", "start", "stop"])

    return editions.select("source", "text", "book").mapInPandas(run, UNIT)


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations, marks included. Two parts are one if a short tag that ends no sentence stands between, after a comma."""
    marks = [m.start() for m in re.finditer('"', text)]
    spans = list(zip(marks[::2], [m + 1 for m in marks[1::2]], strict=False))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out:
            tag = text[out[-1][1] : a]
            if len(tag) <= MOST_TAG and text[out[-1][0] : out[-1][1] - 1].rstrip().endswith(",") and not re.search(r"[.!?]", tag) and "\n\n" not in tag:
                out[-1] = (out[-1][0], b)
                continue
        out.append((a, b))
    return out


def candidate_id(source, start, stop):
    return F.concat(F.lit("lit-"), F.substring(F.sha2(F.concat_ws(":", source, start, stop), 256), 1, 10))
