"""Main text of web pages: flat text blocks, classified by a decision tree over their and their neighbours' features."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zonalith.llm.common import small_batches, text_batches

_token = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[/!?A-Za-z][^>]*\Z",
    re.DOTALL,
)
_named = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|data-testid|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_part = re.compile(r"[a-z]+")

#: Elements whose whole content is no text of the page.
UNSEEN = frozenset("script style noscript template iframe svg math canvas object embed audio video select textarea button head title datalist map".split())
_ends = {name: re.compile(rf"</{name}(?:\s[^>]*)?>", re.IGNORECASE) for name in UNSEEN}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var img wbr".split())
#: Elements and parts of class names of what stands around an article.
AROUND = frozenset("nav footer aside form dialog menu fieldset".split())
AROUND_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment comments commentlist discussion disqus replies reply respond "
    "related recommended recommendations recommendation widget widgets search searchform pagination pager toolbar copyright legal disclaimer complementary contentinfo".split()
)
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("article articlebody main content post entry story".split())


@dataclass
class Block:
    words: int = 0
    linked: int = 0
    around: bool = False
    main: bool = False
    text: str = ""
    parts: list[str] = field(default_factory=list)


#: A class name with one of these says how its element is laid out, not what it is.
MODIFIERS = frozenset("has no with without not non by is".split())


def _names(attributes: str) -> set[str]:
    """The parts of all names that an element is given, without those of names with a modifier."""
    out: set[str] = set()
    if "=" in attributes:
        for m in _named.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _part.findall(name)
                if not MODIFIERS.intersection(parts):
                    out.update(parts)
    return out


def blocks(page: str) -> list[Block]:
    """The page's runs of text without a block element's edge between them, in order, without empty ones.

    An inline element whose name says that it stands around an article counts as such only if it is all of its block: inside
    a sentence it is text like any other.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, inside what stands around, inside an article
    own: list[tuple[str, bool, bool]] = []  # text, in a link, in an inline element that stands around
    inline: list[tuple[str, bool]] = []
    links = 0

    def put(text: str) -> None:
        own.append((text, links > 0, any(on for _, on in inline)))

    def close() -> None:
        if own:
            text = " ".join(html.unescape("".join(t for t, *_ in own)).split())
            if text:
                words = len(text.split())
                linked = len(html.unescape("".join(t if on else " " for t, on, _ in own)).split())
                beside = all(on for t, _, on in own if t.strip())
                out.append(Block(words, min(words, linked), stack[-1][1] or beside, stack[-1][2], text))
            own.clear()

    at = 0
    while m := _token.search(page, at):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:-3], quote=False))
            continue
        end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            links = 0 if end else 1
        if name == "br":
            own.append((" ", False, False))
            continue
        if name in INLINE:
            if not end and name not in VOID:
                inline.append((name, bool(_names(attributes) & AROUND_NAMES)))
            elif end:
                k = next((k for k in range(len(inline) - 1, -1, -1) if inline[k][0] == name), None)
                if k is not None:
                    del inline[k]
            continue
        if name in UNSEEN:
            if not end and not attributes.endswith("/"):  # what comes next is read from its end on
                close()
                close_at = _ends[name].search(page, at)
                at = close_at.end() if close_at else len(page)
            continue
        close()
        if name in VOID or attributes.endswith("/"):
            continue
        inline.clear()  # no inline element reaches over the edge of a block
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
            stack.pop()
        _, around, main = stack[-1]
        names = _names(attributes)
        if name in MAIN:
            main = True
        elif names & MAIN_NAMES and not names & AROUND_NAMES and not around:
            main = True
        if name in AROUND or names & AROUND_NAMES and name not in ("html", "body") or name == "header" and not main or bool(_hidden.search(attributes)):
            around = around or not (name in MAIN and not names & AROUND_NAMES)
        stack.append((name, around, main))
    if at < len(page):
        put(page[at:])
    close()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "around", "place")

#: Labelled blocks: the features above (place: 1 inside an article, 0 outside one, 0.5 on a page without one), then 1 for main text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0.0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 1, 0.0, 0), (12, 0.1, 60, 0.0, 0, 0.0, 1, 0.0, 0),
    (40, 0.0, 55, 0.0, 30, 0.0, 1, 0.0, 0), (25, 0.0, 80, 0.0, 18, 0.0, 1, 1.0, 0), (6, 0.9, 70, 0.0, 5, 0.9, 1, 1.0, 0), (90, 0.0, 12, 0.0, 60, 0.0, 1, 0.5, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 1, 0.5, 0), (5, 0.0, 4, 0.0, 3, 0.0, 1, 0.5, 0), (1, 0.0, 50, 0.0, 40, 0.0, 1, 1.0, 0), (200, 0.0, 90, 0.0, 90, 0.0, 1, 0.0, 0),
    (9, 0.0, 8, 0.0, 60, 0.0, 0, 1.0, 1), (60, 0.0, 9, 0.0, 45, 0.0, 0, 1.0, 1), (1, 0.0, 60, 0.0, 30, 0.0, 0, 1.0, 1), (3, 0.0, 1, 0.0, 2, 0.0, 0, 1.0, 1),
    (45, 0.2, 60, 0.0, 70, 0.1, 0, 1.0, 1), (300, 0.0, 9, 0.0, 12, 0.0, 0, 1.0, 1), (12, 0.5, 45, 0.0, 80, 0.0, 0, 1.0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1.0, 1),
    (4, 1.0, 40, 0.0, 50, 0.0, 0, 1.0, 1), (30, 1.0, 30, 0.0, 30, 0.0, 0, 1.0, 1), (5, 1.0, 5, 1.0, 40, 0.1, 0, 1.0, 1), (7, 0.0, 3, 1.0, 4, 1.0, 0, 1.0, 1),
    (15, 0.0, 40, 0.0, 12, 0.0, 0, 0.0, 0), (4, 0.0, 1, 1.0, 9, 0.0, 0, 0.0, 0), (60, 0.0, 4, 0.0, 50, 0.0, 0, 0.0, 0), (8, 0.9, 60, 0.0, 7, 0.9, 0, 0.0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0.0, 0), (20, 0.0, 300, 0.0, 0, 0.0, 0, 0.0, 0), (90, 0.1, 90, 0.0, 70, 0.0, 0, 0.0, 0), (1, 0.0, 12, 0.0, 40, 0.0, 0, 0.0, 0),
    (60, 0.0, 8, 0.0, 55, 0.0, 0, 0.5, 1), (45, 0.1, 60, 0.0, 70, 0.0, 0, 0.5, 1), (25, 0.0, 5, 1.0, 60, 0.0, 0, 0.5, 1), (9, 0.0, 5, 0.0, 60, 0.0, 0, 0.5, 1),
    (12, 0.0, 40, 0.0, 3, 1.0, 0, 0.5, 1), (3, 0.0, 60, 0.0, 45, 0.0, 0, 0.5, 1), (18, 0.2, 30, 0.0, 25, 0.0, 0, 0.5, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0.5, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0.5, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0.5, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0.5, 1), (8, 0.0, 0, 0.0, 60, 0.0, 0, 0.5, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 0.5, 0), (5, 0.9, 60, 0.0, 4, 1.0, 0, 0.5, 0), (12, 0.8, 9, 0.9, 10, 0.9, 0, 0.5, 0), (40, 0.7, 30, 0.8, 60, 0.0, 0, 0.5, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0.5, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 0.5, 0), (6, 0.5, 2, 1.0, 3, 0.0, 0, 0.5, 0), (1, 1.0, 80, 0.0, 0, 0.0, 0, 0.5, 0),
)

#: Blocks inside an article count as main text at any length and density, unless something around an article holds them.
LABELLED += tuple((w, d, 9, d, a, 0.0, r, 1.0, 1 - r) for w in (1, 4, 40) for d in (0.0, 0.4, 1.0) for a in (0, 5, 60) for r in (0, 1))


@dataclass
class Leaf:
    keep: bool


@dataclass
class Split:
    feature: int
    most: float
    below: Split | Leaf
    above: Split | Leaf


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Split | Leaf:
    """A decision tree that splits where the Gini impurity falls most; ties go to the first feature and threshold."""
    share = labels.mean() if len(labels) else 0.0
    best: tuple[float, int, float] | None = None
    if 0 < share < 1 and depth:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                on = rows[:, f] <= cut
                p, q = labels[on].mean(), labels[~on].mean()
                impurity = on.mean() * p * (1 - p) + (~on).mean() * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(cut)
    if best is None:
        return Leaf(bool(share >= 0.5))
    on = rows[:, best[1]] <= best[2]
    return Split(best[1], best[2], train(rows[on], labels[on], depth - 1), train(rows[~on], labels[~on], depth - 1))


def default_tree() -> Split | Leaf:
    table = np.array(LABELLED, np.float64)
    return train(table[:, :-1], table[:, -1])


def classify(found: list[Block], tree: Split | Leaf) -> list[bool]:
    has_main = any(b.main and not b.around for b in found)
    own = [(float(b.words), b.linked / b.words) for b in found]
    sides = [(0.0, 0.0), *own, (0.0, 0.0)]
    out = []
    for i, b in enumerate(found):
        row = (*own[i], *sides[i], *sides[i + 2], float(b.around), float(b.main) if has_main else 0.5)
        node = tree
        while isinstance(node, Split):
            node = node.below if row[node.feature] <= node.most else node.above
        out.append(node.keep)
    return out


def main_text(page: str | None, tree: Split | Leaf) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, classify(found, tree), strict=True) if keep)


class _Extract:
    def __init__(self, tree: Split | Leaf):
        self.tree = tree

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            texts = [main_text(p, self.tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, tree: Split | Leaf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    The whole html is read; a null one is empty, and a page without main text has the empty string.  Unclosed tags,
    comments and scripts at the end of a page are markup.  Null ids and urls and repeated rows are carried as they are; an
    empty table gives no rows.  Other columns are not looked at.  No shuffle: each page is read on its own.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_Extract(tree or default_tree()), "page_id long, url string, text string, n_chars long")
