"""Main text of web pages: flat text blocks, classified by a decision tree on words, link density and their neighbours.

A page is cut at block elements into a flat list of texts. Each block is described by its number of words and its link
density, by those of the blocks before and after it, and by what it stands in: an article, a container that names something
else, a heading, a paragraph. A tree, grown here on a small labelled table, says which blocks are main text. In an article it
drops short links among links, a menu; in a page without one it keeps runs of text by words and neighbours.

Tags are read as HTML reads them: quotes count only where an attribute's value starts, an item, cell, row or paragraph ends
where the next begins, and an end tag without its start does nothing. Names in class, id and role say that an element is not
the article only as whole names, and not of an element that is, or holds, the page's main element or first article if
without it nothing would be left of the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.texts import append

#: Element names, fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe textarea select title".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where one of the second group begins, unless one of the third has begun since.
_CELL = frozenset("td th".split())
_ROW = _CELL | {"tr"}
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (_CELL, frozenset("table tr".split())), "th": (_CELL, frozenset("table tr".split())), "tr": (_ROW, frozenset(["table"])),
    **{g: (_ROW | {"thead", "tbody", "tfoot"}, frozenset(["table"])) for g in ("thead", "tbody", "tfoot")},
}
_END_STOPS = {t: stops for t, (_, stops) in IMPLIED.items()}

#: Words in class, id and role that name something other than the article. A name counts if all its words are here or in NEUTRAL.
CUES = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus share sharing subscribe newsletter signup pagination pager widget widgets".split())
#: Such words that an article may use for its own sections: they count outside of articles only.
WEAK_CUES = frozenset("alert side aside header masthead reply replies respond discussion social login search related recommended toolbar copyright legal skip".split())
NEUTRAL = frozenset("left right top bottom main site page global primary secondary list area section box bar wrap wrapper container block item items link links text body inner outer holder unit slot user reader readers article post entry form thread js".split())
_COMMENTS = re.compile(r"(?:\d+ |no |all |reader |readers'? |your |user )?comments?(?: \(?\d+\)?)?:?|leave a (?:comment|reply)|join the discussion", re.I)

# a quote counts only where a value begins; possessive repeats, so that no tag is read twice
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s]*+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")


def cued(named: str, in_main: bool) -> bool:
    """Whether one of the names, parted by white space, says that an element is not the article."""
    for name in named.lower().split():
        words = _WORD.findall(name)
        if any(w in CUES or (not in_main and w in WEAK_CUES) for w in words) and all(w in CUES or w in WEAK_CUES or w in NEUTRAL for w in words):
            return True
    return False


class Mark:
    """A container that names something else; ``held`` once it turns out to hold the article, then it says nothing."""

    __slots__ = ("above", "held")

    def __init__(self, above: Mark | None):
        self.above, self.held = above, False


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    hard: bool  #: in an element that never is the article
    mark: Mark | None
    main: bool  #: in article or main
    heading: bool
    paragraph: bool

    @property
    def aside(self) -> bool:
        m = self.mark
        while m and m.held:
            m = m.above
        return self.hard or m is not None


class Open:
    """An open block element: what holds for its text, and the inline elements that stand open in it since one was dropped."""

    __slots__ = ("tag", "hard", "form", "mark", "main", "inline")

    def __init__(self, tag: str, hard: bool, form: bool, mark: Mark | None, main: bool):
        self.tag, self.hard, self.form, self.mark, self.main, self.inline = tag, hard, form, mark, main, None


_ROOT = Open("", False, False, None, False)


class Reader:
    """Cuts one page into blocks; time grows in proportion to the page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.in_link, self.heading = 0, False, ""
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        self.holders: dict[str, Mark | None] = {}  # marks around the first main, the first article in one and the first elsewhere

    def text(self, raw: str) -> None:
        if not raw or (self.stack and self.stack[-1].inline):
            return
        decoded = html.unescape(raw) if "&" in raw else raw
        self.parts.append(decoded)
        if self.in_link:
            self.linked += len(decoded.split())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top, n = self.stack[-1] if self.stack else _ROOT, text.count(" ") + 1
                self.blocks.append(Block(text, n, min(1.0, self.linked / n), top.hard or top.form, top.mark, top.main, bool(self.heading), top.tag == "p"))
        self.parts, self.linked = [], 0

    def pop(self, at: int) -> None:
        for e in self.stack[at:]:
            self.places[e.tag].pop()
            if e.tag == self.heading:
                self.heading = ""
        del self.stack[at:]

    def last(self, tags: frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def attributes(self, raw: str) -> tuple[str, bool]:
        """The names in class, id and role, and whether the element is hidden."""
        named, unseen = "", False
        for name, value in _ATTRIBUTE.findall(raw):
            name = name.lower()
            if name in ("class", "id", "role"):
                named += " " + value.strip("\"'")
            unseen |= name == "hidden" or (name == "style" and bool(_UNSEEN.search(value)))
        return named, unseen

    def open(self, tag: str, raw: str) -> None:
        top = self.stack[-1] if self.stack else _ROOT
        if tag not in BLOCKS:
            if tag == "a":
                self.in_link = True
            elif tag in ("br", "img"):
                self.text(" ")
            if tag in VOID or tag == "a" and not raw:
                return
            named, unseen = self.attributes(raw) if raw else ("", False)
            if top.inline or unseen or cued(named, top.main):
                if not self.stack:
                    self.push("div", Open("div", False, False, None, False))
                    top = self.stack[-1]
                top.inline = top.inline or []
                top.inline.append(tag)
            return
        self.flush()
        if top.tag == "p":
            self.pop(len(self.stack) - 1)
        if tag in HEADINGS and self.heading:
            self.pop(self.places[self.heading][-1])
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            stop = self.last(stops)
            while (at := self.last(ends)) > stop:
                self.pop(at)
        if tag in VOID:
            return
        top = self.stack[-1] if self.stack else _ROOT
        named, unseen = self.attributes(raw) if raw and tag not in ("html", "body") else ("", False)
        hard = top.hard or unseen or tag in ASIDE or (tag == "header" and not top.main)
        mark, main = top.mark, (top.main or tag in MAIN) and not hard
        if tag not in HEADINGS and cued(named, top.main):
            mark = Mark(mark)
        if tag in MAIN and not hard:
            self.holders.setdefault("inner" if tag == "article" and self.places.get("main") else tag, mark)
        self.push(tag, Open(tag, hard, not hard and tag not in MAIN and (top.form or tag == "form"), mark, main))
        if tag in HEADINGS:
            self.heading = tag

    def push(self, tag: str, element: Open) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(element)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag not in BLOCKS:
            inline = self.stack[-1].inline if self.stack else None
            if inline and inline[-1] == tag:
                inline.pop()
            elif inline and tag in inline[-64:]:  # ends that are out of order are looked for among the innermost
                while inline.pop() != tag:
                    pass
            return
        self.flush()
        at = self.last(frozenset([tag]))
        if at >= 0 and at > self.last(_END_STOPS.get(tag, frozenset())):
            self.pop(at)

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if not m:
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.close(tag)
                continue
            if tag not in RAW:
                self.open(tag, m[3])
                continue
            stop = _raw_end(tag).search(page, at)
            at = stop.start() if stop else end
        self.flush()
        for tag in ("main", "inner", "article"):  # the first article only where there is no main element, or nothing else in it
            if tag in self.holders and not any(b.main and not b.aside for b in self.blocks):
                m = self.holders[tag]
                while m:
                    m.held, m = True, m.above
        return self.blocks


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


def blocks_of(page: str) -> list[Block]:
    return Reader().read(page)


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "aside", "main", "page_has_main", "heading", "paragraph")

#: The labelled table: features in the order above, then 1 for main text. Invented for this purpose.
TABLE = """
6 0.0 0 0.0 80 0.0 0 1 1 1 0 1
80 0.0 6 0.0 60 0.0 0 1 1 0 1 1
1 0.0 60 0.0 40 0.0 0 1 1 0 1 1
3 0.0 2 0.0 90 0.0 0 1 1 0 0 1
12 0.9 50 0.0 70 0.0 0 1 1 0 1 1
1 1.0 20 0.0 30 0.1 0 1 1 0 0 1
2 1.0 0 0.0 25 0.0 0 1 1 0 0 1
3 1.0 40 0.1 0 0.0 0 1 1 0 0 1
45 0.2 1 1.0 4 0.0 0 1 1 0 1 1
5 0.0 120 0.0 9 0.0 0 1 1 0 0 1
150 0.0 5 0.0 12 0.1 0 1 1 0 1 1
2 0.0 0 0.0 3 0.0 0 1 1 1 0 1
4 0.0 200 0.0 0 0.0 0 1 1 0 1 1
30 0.0 10 1.0 2 1.0 0 1 1 0 1 1
4 0.0 2 1.0 2 1.0 0 1 1 1 0 1
9 1.0 8 1.0 11 1.0 0 1 1 0 0 1
6 0.9 7 1.0 9 0.9 0 1 1 0 0 1
8 1.0 60 0.0 7 1.0 0 1 1 0 0 1
3 0.6 2 0.7 4 0.6 0 1 1 0 0 1
2 0.0 2 0.0 1 0.0 0 1 1 0 0 1
1 0.0 0 0.0 1 1.0 0 1 1 0 1 1
2 0.0 40 0.0 2 1.0 0 1 1 0 1 1
3 0.1 2 1.0 30 0.0 0 1 1 0 1 1
1 0.0 3 1.0 1 1.0 0 1 1 0 0 1
3 0.4 1 1.0 0 0.0 0 1 1 0 1 1
2 0.0 1 1.0 2 1.0 0 1 1 1 0 1
12 1.0 30 0.0 2 0.0 0 1 1 0 1 1
8 1.0 2 0.0 3 0.0 0 1 1 0 1 1
2 1.0 3 0.0 4 0.0 0 1 1 0 1 1
1 1.0 60 0.0 5 0.0 0 1 1 0 1 1
3 1.0 2 0.0 80 0.0 0 1 1 0 0 1
5 0.8 4 0.1 0 0.0 0 1 1 0 1 1
1 1.0 1 0.0 1 0.0 0 1 1 0 0 1
2 1.0 0 0.0 0 0.0 0 1 1 0 1 1
1 1.0 5 0.0 0 0.0 0 1 1 0 0 1
3 1.0 8 0.0 2 0.1 0 1 1 0 1 1
10 1.0 3 1.0 2 1.0 0 1 1 0 0 1
7 1.0 1 1.0 1 1.0 0 1 1 0 0 1
12 0.9 2 1.0 5 1.0 0 1 1 0 0 1
5 1.0 6 1.0 5 1.0 0 1 1 0 0 1
9 1.0 40 0.0 2 1.0 0 1 1 0 0 1
3 1.0 3 1.0 3 1.0 0 1 1 0 0 0
1 1.0 2 1.0 30 0.0 0 1 1 0 0 0
2 1.0 30 0.0 1 1.0 0 1 1 0 0 0
3 1.0 3 1.0 8 0.0 0 1 1 0 0 0
1 1.0 4 0.0 3 1.0 0 1 1 0 0 0
2 1.0 90 0.0 1 1.0 0 1 1 0 0 0
1 1.0 1 1.0 2 0.0 0 1 1 0 0 0
1 1.0 1 1.0 1 1.0 0 1 1 0 0 0
2 1.0 1 1.0 2 1.0 0 1 1 0 0 0
3 1.0 2 1.0 1 1.0 0 1 1 0 0 0
1 1.0 70 0.0 2 1.0 0 1 1 0 0 0
3 1.0 5 0.0 1 1.0 0 1 1 0 0 0
2 1.0 2 1.0 40 0.0 0 1 1 0 0 0
1 1.0 3 1.0 0 0.0 0 1 1 0 0 0
1 1.0 1 1.0 1 1.0 1 0 1 0 0 0
2 1.0 0 0.0 1 1.0 1 0 1 0 0 0
1 1.0 1 1.0 15 0.0 1 0 0 0 0 0
15 0.0 1 1.0 6 0.0 1 0 1 0 0 0
60 0.0 1 1.0 8 0.0 1 0 1 0 1 0
90 0.1 7 0.0 100 0.0 1 0 0 0 1 0
25 0.1 120 0.0 0 0.0 1 0 1 0 0 0
20 0.0 80 0.0 0 0.0 1 0 0 0 1 0
70 0.0 90 0.0 40 0.0 1 1 1 0 1 0
40 0.0 70 0.0 35 0.0 1 0 0 0 1 0
4 0.0 90 0.0 50 0.0 1 1 1 1 0 0
3 0.0 80 0.0 2 0.5 1 0 0 1 0 0
90 0.0 70 0.0 80 0.0 1 1 1 0 1 0
200 0.0 60 0.0 9 0.0 1 0 0 0 1 0
30 0.0 90 0.0 60 0.0 1 1 1 0 0 0
12 0.0 0 0.0 8 0.0 0 0 1 0 0 0
70 0.0 3 0.0 6 0.0 0 0 1 0 1 0
2 1.0 0 0.0 3 1.0 0 0 1 0 0 0
40 0.1 90 0.0 1 1.0 0 0 1 0 1 0
5 0.0 12 0.0 10 0.0 0 0 1 1 0 0
100 0.0 90 0.0 80 0.0 0 0 1 0 1 0
200 0.0 2 0.0 9 0.0 0 0 1 0 0 0
4 0.0 90 0.0 0 0.0 0 0 1 0 1 0
2 1.0 1 1.0 2 1.0 0 0 0 0 0 0
8 1.0 2 1.0 60 0.0 0 0 0 0 0 0
3 0.8 70 0.0 2 1.0 0 0 0 0 1 0
20 0.7 3 1.0 5 0.9 0 0 0 0 0 0
30 0.8 60 0.0 50 0.0 0 0 0 0 1 0
6 1.0 90 0.0 0 0.0 0 0 0 0 0 0
12 0.9 40 0.0 9 0.0 0 0 0 0 1 0
4 0.0 2 1.0 3 1.0 0 0 0 0 0 0
3 0.0 1 1.0 0 0.0 0 0 0 0 0 0
1 0.0 0 0.0 60 0.0 0 0 0 0 0 0
2 0.0 3 0.0 70 0.0 0 0 0 0 0 0
2 0.0 60 0.0 0 0.0 0 0 0 0 0 0
4 0.0 90 0.0 0 0.0 0 0 0 0 0 0
6 0.0 3 1.0 3 1.0 0 0 0 1 0 0
5 0.0 0 0.0 4 1.0 0 0 0 1 0 0
2 0.0 9 0.0 2 1.0 0 0 0 1 0 0
60 0.0 6 0.0 70 0.0 0 0 0 0 1 1
25 0.1 70 0.0 90 0.0 0 0 0 0 1 1
30 0.0 2 1.0 40 0.0 0 0 0 0 0 1
8 0.0 60 0.0 80 0.0 0 0 0 0 0 1
3 0.0 90 0.0 50 0.0 0 0 0 0 1 1
7 0.0 2 1.0 80 0.0 0 0 0 1 0 1
5 0.0 70 0.1 90 0.0 0 0 0 1 0 1
4 0.0 0 0.0 30 0.0 0 0 0 1 0 1
3 0.0 0 0.0 2 0.0 0 0 0 1 0 1
90 0.2 60 0.0 3 1.0 0 0 0 0 0 1
60 0.0 1 0.0 1 1.0 0 0 0 0 1 1
120 0.1 0 0.0 0 0.0 0 0 0 0 0 1
22 0.0 4 0.0 3 0.0 0 0 0 0 0 1
300 0.0 2 1.0 2 1.0 0 0 0 0 0 1
2 0.0 0 0.0 0 0.0 0 0 0 0 1 1
2 0.0 3 0.0 0 0.0 0 0 0 0 1 1
3 0.0 1 1.0 2 0.0 0 0 0 0 1 1
5 0.2 40 0.0 2 1.0 0 0 0 0 1 1
1 0.0 2 0.0 3 0.0 0 0 0 0 1 1
9 0.0 8 0.0 2 1.0 0 0 0 0 1 1
"""


@dataclass
class Tree:
    """Leaf: ``keep``. Else: feature and bound, low (value <= bound) and high."""

    keep: bool
    feature: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Binary tree by Gini impurity; of equal splits the first feature and the lowest bound. It ends at pure leaves or at ``depth``."""
    share = y.mean()
    leaf = Tree(bool(share >= 0.5))
    if depth == 0 or share in (0, 1):
        return leaf
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            cost = sum(2 * y[s].mean() * (1 - y[s].mean()) * s.sum() for s in (low, ~low))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(bound))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(leaf.keep, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def tree() -> Tree:
    table = np.array([line.split() for line in TABLE.split("\n") if line], dtype=float)
    return grow(table[:, :-1], table[:, -1])


def is_main(row: tuple[float, ...], node: Tree) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.bound else node.high
    return node.keep


def main_text(page: str) -> str:
    """Blocks of main text in page order, joined by two line feeds."""
    blocks, node = blocks_of(page), tree()
    # what follows a heading of readers' comments, up to the next heading outside of it, is theirs
    aside, theirs, last = [b.aside for b in blocks], False, max((k for k, b in enumerate(blocks) if b.main), default=-1)
    for k, b in enumerate(blocks):
        theirs = bool(_COMMENTS.fullmatch(b.text)) if b.heading else theirs and (b.main or k > last)
        aside[k] = aside[k] or theirs
    has_main = any(b.main and not a for b, a in zip(blocks, aside, strict=True))
    none, kept = (0, 0.0), []
    sizes = [none, *((b.words, b.link_density) for b in blocks), none]
    for k, b in enumerate(blocks):
        row = (*sizes[k + 1], *sizes[k], *sizes[k + 2], aside[k], b.main, has_main, b.heading, b.paragraph)
        if is_main(row, node):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text string and n_chars long (its code points). A null or empty page, or one without main text, gives "" and 0.

    Rows keep their other columns, null or repeated ones too; columns named text or n_chars are replaced. An empty table
    gives an empty result.
    """

    def make():
        def run(texts):
            found = [main_text(t) for t in texts]
            return found, [len(t) for t in found]

        return run

    return append(pages, html_col, "text string, n_chars long", make)


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", F.col("html").alias("_html")), "_html").drop("_html")
