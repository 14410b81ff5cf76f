"""HTML extraction (3) by tag-path ratios.

Every page is cut into blocks; a block is a leaf with its path of tags from the root. Over the blocks
of a path, text length and punctuation are summed and divided by the number of blocks (the two
ratios). The ratios are fused into one score, less the share of link text, and weighted by what the
tags of the path say (0 for menus, adverts, forms, comments and the like, unless such a name or form
stands around most of the page's article, or of its text where there is no article). A path's score is smoothed
with that of the container its blocks stand in (the outermost article, main or content element, else
the nearest container), so that a heading, a table cell or a quotation follows its article. Blocks whose path reaches a share of the page's mean score are the main text.

Pages are independent of one another: the work is an Arrow-batched function of the html column alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.2  # share of the page's mean score that a path must reach

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<[!?/][^>]*+>"
    r"|<(?P<loose>/?[a-z][^\s/>]*+)[^>]*+>"
    r"|</?[a-z][^>]*+\Z",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
BLANK = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")

# Fixed values of HTML: elements without content, inline elements, what an open paragraph ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br".split()
)
ONE_OPEN = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table article section div main body td th blockquote figure".split())

CONTAINERS = frozenset("article main section div td blockquote center".split())

# What tags and names of class, id or role say about a path.
OFF_TAGS = frozenset("nav footer aside form button select menu dialog head canvas object".split())
OFF_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended comments comment respond reply "
    "disqus pagination pager widget skip search form contentinfo complementary".split()
)
#: A name with one of these says something about the page, not what the element is (has-sidebar, comments-open).
STATE = frozenset("has have is no not with without open closed enabled disabled".split())
#: Beside one of the names above these say that an element is of that kind; other words make it a name of its own (related-work).
COMPANIONS = frozenset(
    "post posts article articles link links list box area section button buttons bar slot container wrapper wrap form block unit item items "
    "story stories text content inner outer main site page global primary secondary left right top bottom col column panel field input "
    "message card title heading icon icons media holder row group 1 2 3 4".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINKED = 0.3  # share of link text at which an unclear name inside an article counts as boilerplate
GOOD_TAGS = frozenset("article main".split())
GOOD_NAMES = frozenset("article main content post entry story body-text".split())


class Page:
    """The blocks of a page: text, path (tuple of marks), characters of links, container (0: the page itself).

    ``elements`` has the numbers of the elements of each block's path.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, tuple[str, ...], int, int]] = []
        self.elements: list[tuple[int, ...]] = []
        self.stack: list[tuple[str, str, int]] = []  # tag, mark, number
        self.opened = 0
        self.parts: list[str] = []
        self.path: tuple[str, ...] = ()
        self.numbers: tuple[int, ...] = ()
        self.box = 0
        self.links = 0
        at = 0
        for m in TOKEN.finditer(html):
            self._text(html[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["loose"]
            if tag:
                closing = bool(m["end"]) or tag[0] == "/"
                self._tag(tag.lstrip("/").lower(), closing, m["attrs"] or "")
        self._text(html[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if text:
            if "&" in text:
                text = unescape(text)
            if not self.path and not text.isspace():
                self.path = tuple(mark for _, mark, _ in self.stack)
                self.numbers = tuple(n for _, _, n in self.stack)
                nearest = next((n for tag, _, n in reversed(self.stack) if tag in CONTAINERS), 0)
                self.box = next((n for tag, mark, n in self.stack if tag not in ("body", "html") and mark_says(mark)[2]), nearest)
            if any(tag == "a" for tag, _, _ in self.stack):
                self.links += len(text.strip())
            self.parts.append(text)

    def _flush(self) -> None:
        text = BLANK.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.path, self.links, self.box))
            self.elements.append(self.numbers)
        self.parts, self.path, self.links, self.box = [], (), 0, 0

    def _tag(self, tag: str, closing: bool, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if closing:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break
                if tag in INLINE and self.stack[i][0] not in INLINE:
                    break  # it does not reach out of its block
            return
        ends = ONE_OPEN.get(tag) or ({"p"} if tag not in INLINE else None)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    del self.stack[i:]
                    break
                if self.stack[i][0] in BARRIER:
                    break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)) if "=" in attrs else ""
        self.opened += 1
        self.stack.append((tag, f"{tag} {names.lower()}" if names else tag, self.opened))


@lru_cache(4096)
def mark_says(mark: str) -> tuple[bool, bool, bool]:
    """Of one element: it is boilerplate; it is boilerplate outside an article; it is an article."""
    tag, *names = mark.split(" ")
    words = {w for name in names for w in (name, *re.split(r"[-_]+", name))}
    off = tag in OFF_TAGS or tag not in ("body", "html") and tag not in HEADINGS and any(map(off_name, names))
    return off, tag == "header", tag in GOOD_TAGS or bool(words & GOOD_NAMES)


def off_name(name: str) -> bool:
    words = re.split(r"[-_]+", name)
    return name in OFF_NAMES or not STATE.intersection(words) and bool(OFF_NAMES.intersection(words))


def unclear(name: str) -> bool:
    """A name of several parts of which only some speak of boilerplate (market-share, notice-period)."""
    words = set(re.split(r"[-_]+", name))
    return off_name(name) and name not in OFF_NAMES and not words <= OFF_NAMES | COMPANIONS


def without_wrappers(page: Page) -> list[tuple[str, tuple[str, ...], int, int]]:
    """The blocks with the boilerplate marks of wrappers taken out of their paths.

    A boilerplate name, or a form, is that of a wrapper if it holds more than half of the text of the
    page's articles and is not inside one; on a page without articles, if it holds more than half of the
    page's text. Text of links and text under other boilerplate tags don't count. Inside an article, unclear names
    are taken out as well unless much of the element's text is links.
    """
    held: dict[tuple[int, bool], int] = defaultdict(int)  # by element and whether in an article: characters that count
    marked: dict[int, str] = {}
    doubtful: dict[int, list[int]] = defaultdict(lambda: [0, 0])  # characters and those of links, of unclear names inside an article
    total = {True: 0, False: 0}
    for (text, path, links, _), numbers in zip(page.blocks, page.elements):
        tags = [mark.split(" ", 1)[0] for mark in path]
        first = next((i for i, tag in enumerate(tags) if tag in GOOD_TAGS), len(path))
        for i, mark in enumerate(path):
            if i > first and tags[i] not in OFF_TAGS and all(map(unclear, filter(off_name, mark.split(" ")[1:]))) and mark_says(mark)[0]:
                doubtful[numbers[i]][0] += len(text)
                doubtful[numbers[i]][1] += min(links, len(text))
            # The article itself may have the name; what is inside it is judged as before.
            if mark_says(mark)[0] and (tags[i] == "form" or tags[i] not in OFF_TAGS) and (i <= first or tags[i] == "form"):
                marked[numbers[i]] = mark
        if any(tag in OFF_TAGS and tag != "form" for tag in tags):
            continue
        chars = max(len(text) - links, 0)
        total[first < len(path)] += chars
        for n in numbers:
            held[n, first < len(path)] += chars
    if not marked and not doubtful:
        return page.blocks
    inside = total[True] > 0
    wrappers = {n for n in marked if 2 * held[n, inside] > total[inside]}
    wrappers |= {n for n, (chars, linked) in doubtful.items() if linked < LINKED * chars}
    if not wrappers:
        return page.blocks

    def plain(mark: str) -> str:
        tag, *names = mark.split(" ")
        return " ".join(["div" if tag == "form" else tag, *(x for x in names if not off_name(x))])

    return [
        (text, tuple(plain(m) if n in wrappers else m for m, n in zip(path, numbers)), links, box)
        for (text, path, links, box), numbers in zip(page.blocks, page.elements)
    ]


def weight(path: tuple[str, ...]) -> float:
    """What the marks of a path say: 0 for boilerplate, more than 1 inside an article."""
    out = 1.0
    for off, off_outside, good in map(mark_says, path):
        if off or off_outside and out == 1.0:
            return 0.0
        if good:
            out = 4.0
    return out


def in_article(path: tuple[str, ...]) -> bool:
    return any(mark_says(mark)[2] for mark in path)


def text_element(page: Page, blocks: list, mass: list[float]) -> int:
    """The innermost element that holds most of the score, on a page without an article; 0 is the page."""
    if not sum(mass) or any(m and in_article(path) for (_, path, _, _), m in zip(blocks, mass)):
        return -1
    held: dict[int, float] = defaultdict(float)
    for numbers, m in zip(page.elements, mass):
        for n in numbers:
            held[n] += m
    return max((n for n, m in held.items() if m >= 0.6 * sum(mass)), default=0)


def boxes(page: Page, blocks: list, mass: list[float]) -> list[int | None]:
    """The container with which a block is smoothed; None: it stands alone.

    Without an article the element of the text takes this place; a title and what stands between it and
    the text belong to it, as do blocks that have no container of their own where that element is the page."""
    found = [box or None for _, _, _, box in blocks]
    root = text_element(page, blocks, mass)
    if root < 0:
        return found
    inside = [root in numbers for numbers in page.elements] if root else [True] * len(blocks)
    tag = next((m.split(" ", 1)[0] for (_, path, _, _), ns in zip(blocks, page.elements) for m, n in zip(path, ns) if n == root), "body")
    alone = tag not in ("body", "html")  # an element for the text itself
    first = inside.index(True)
    title = next((i for i in range(first) if any(m.split(" ", 1)[0] in ("h1", "h2") for m in blocks[i][1])), first)
    for i, here in enumerate(inside):
        if here and (alone or found[i] is None) or title <= i < first:
            found[i] = -1
    return found


def main_text(html: str | None) -> str:
    """The main text of a page: its content blocks in page order, joined by an empty line.

    Null and blank pages, and pages without a content block, give the empty text.
    """
    if not html:
        return ""
    page = Page(html)
    blocks = without_wrappers(page)
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for text, path, links, _ in blocks:
        s = sums[path]
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
        s[3] += min(links, len(text))
    score = {}
    for path, (chars, marks, n, links) in sums.items():
        plain = (1 - links / chars) ** 2
        # inside an article a linked heading or list item only counts less than its neighbours
        score[path] = weight(path) * (chars / n) * (1 + marks / n) * (max(plain, 0.01) if in_article(path) else plain)
    box_of = boxes(page, blocks, [score[path] * len(text) for text, path, _, _ in blocks])
    inside: dict[int, list[float]] = defaultdict(lambda: [0, 0])
    for (text, path, _, _), box in zip(blocks, box_of):
        if box is not None and score[path] > 0:
            inside[box][0] += score[path] * len(text)
            inside[box][1] += len(text)

    def smooth(path: tuple[str, ...], box: int | None) -> float:
        total, chars = inside[box] if box in inside else (0, 1)
        return max(score[path], total / chars / 2) if score[path] > 0 else 0.0

    smoothed = [(text, smooth(path, box)) for (text, path, _, _), box in zip(blocks, box_of)]
    mass = sum(len(text) for text, s in smoothed if s > 0)
    if not mass:
        return ""
    mean = sum(s * len(text) for text, s in smoothed) / mass
    return "\n\n".join(text for text, s in smoothed if s > 0 and s >= THRESHOLD * mean)


def text_of(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            yield pd.Series([main_text(h) for h in series], dtype=object)

    return extract(html)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (never null) and n_chars (its code points) in place of columns of these names.

    Rows are independent, so repeated rows give repeated results. Empty in, empty out.
    """
    out = pages.withColumn("text", text_of(F.coalesce(F.col(html_col), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))
