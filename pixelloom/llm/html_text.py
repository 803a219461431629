"""Main text of web pages.

The standard library's parser streams a page's events into lines: a line is
the text between two block boundaries, with the number of tags met in it and
the block element it lies in. End tags that HTML lets out are supplied: a block
closes an open paragraph, a list item the one before, body the head. Each line
has a text-to-tag ratio; the ratios are smoothed with a Gaussian, and lines
above a threshold form content clusters.

Lines inside menus, headers, footers, asides, scripts, styles and hidden elements
never count. Forms, and elements whose class, id or role names such a thing, are
weighed by the clusters' text that all of the same name hold together: a form or
a name that can also be a topic counts if it holds more than half of it, any other
name if it holds NAME_SHARE of it or all that is not named; reader comments count
only if nothing else is there and a page's heading stands among them. A form around
a main element or an article is none.

The content region is the main element, or all articles together, if they hold
most of the clusters' text, else the smallest element that covers all clusters,
a part such as a paragraph or a list counting with what it lies in. All counted
lines of the region are returned, short ones too.

Rows: a null page counts as empty and has no text; pages are read whole;
malformed markup is parsed as far as the parser goes; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template svg math canvas iframe object audio video head title".split())
BOILERPLATE = frozenset("nav header footer aside button select textarea fieldset dialog menu".split())
#: Fixed values of HTML: what may stand in the head, what closes an open paragraph, and what the search for an open element never leaves.
HEADED = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
BOUNDS = frozenset("html table td th caption template object marquee applet button select".split())
#: Fixed values of HTML: for an opening tag, the elements that it closes and those beyond which it does not look.
FOLLOWS = {
    "li": (frozenset(["li"]), BOUNDS | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), BOUNDS | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), BOUNDS | {"dl"}),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select"])),
}
TABULAR = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: Words of class, id and role that name boilerplate; those of the second line can also name what a page is about, those of the third name reader comments.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers masthead toolbar cookie cookies consent gdpr popup popups modal modals overlay newsletter subscribe subscription signup login pagination pager skip complementary contentinfo widget widgets".split()
)
TOPICS = frozenset("sponsor promo promos side aside header headers notice notices alert alerts social share sharing related recommended search legal copyright".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Beside one of these, such a word tells of the page's layout or state, not of the element.
LAYOUT = frozenset("with without has no non free off layout open closed enabled disabled".split())
#: On a paragraph, a heading or a list item, these tell how it looks.
STYLES = frozenset("header headers side alert alerts legal search".split())
STYLED = HEADINGS | frozenset("p li dt dd td th blockquote pre".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z0-9]+")
#: Parts of a region, never one themselves.
PARTS = HEADINGS | INLINE | frozenset("p li td th tr pre blockquote ul ol dl dt dd table thead tbody tfoot figure figcaption details".split())
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Share of the clusters' text that main or the articles must hold, and that elements must under a name that is no topic.
SHARE, NAME_SHARE = 0.6, 0.8
TOPIC, NAME, COMMENT = 1, 2, 3
UNNAMED = (0, "")


class Node:
    """An element that is open or was, as far as lines need it.

    `bad` if it never counts, `name` the kind and word by which it is named as
    boilerplate, `main` and `article` the outermost of these around it or itself,
    `headed` if it lies in a page's heading. Elements are numbered as they open.
    """

    __slots__ = ("tag", "parent", "bad", "name", "number", "main", "article", "headed")

    def __init__(self, tag: str, parent: Node | None, bad: bool, name: tuple[int, str] = UNNAMED, number: int = 0):
        self.tag, self.parent, self.bad, self.name, self.number = tag, parent, bad, name, number
        self.main = parent and parent.main or (self if tag == "main" else None)
        self.article = parent and parent.article or (self if tag == "article" else None)
        self.headed = tag == "h1" or bool(parent and parent.headed)


def hides(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes hide the element."""
    return any(k == "hidden" or k == "style" and v and UNSEEN.search(v.lower()) for k, v in attrs)


def kind_of_name(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, str]:
    """The kind, TOPIC, NAME or COMMENT, and the word of class, id or role that names boilerplate; of an article only names of one word count."""
    found = UNNAMED
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for token in v.split():
                words = WORD.findall(CAMEL.sub("-", token).lower())
                if tag == "article" and len(words) > 1 or LAYOUT.intersection(words):
                    continue
                for w in words:
                    kind = COMMENT if w in COMMENTS else NAME if w in NAMES else TOPIC if w in TOPICS else 0
                    if kind and not (w in STYLES and tag in STYLED):
                        found = max(found, (kind, w))
    return found


class Lines(HTMLParser):
    """Collects (text, tags, node) per line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, False)
        self.nodes = [self.node]
        self.forms: list[Node] = []
        self.open: dict[str, int] = {}
        self.silent = 0
        self.lines: list[tuple[str, int, Node]] = []
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, max(1, self.tags), self.node))
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        inline = tag in INLINE
        if self.open.get("head") and tag not in HEADED:
            self._shut(frozenset(["head"]), frozenset())
        if inline:
            # an inline element can be boilerplate too; then it is taken as a block, and those of its tag inside it are counted
            if not (kind_of_name(tag, attrs)[0] or hides(attrs)):
                if self.open.get(tag):
                    self._push(tag, self.node.bad, UNNAMED)
                return
        self.cut()
        if tag in CLOSES_P:
            self._shut(frozenset(["p"]), BOUNDS)
        if tag in FOLLOWS:
            self._shut(*FOLLOWS[tag])
        elif tag in HEADINGS and self.node.tag in HEADINGS:
            self._shut(HEADINGS, frozenset())
        if tag in VOID:
            return
        name = UNNAMED if tag in ("html", "body", "main") else kind_of_name(tag, attrs)
        if tag == "form":
            name = max(name, (TOPIC, "form"))
        elif tag in ("main", "article"):
            # forms that are still open here are wrapped around the page
            for form in self.forms:
                form.name = UNNAMED
            self.forms.clear()
        self._push(tag, self.node.bad or tag in BOILERPLATE or hides(attrs), name)
        if name[1] == "form":
            self.forms.append(self.node)

    def _push(self, tag: str, bad: bool, name: tuple[int, str]) -> None:
        self.node = Node(tag, self.node, bad, name, len(self.nodes))
        self.nodes.append(self.node)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in NO_TEXT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()

    def _shut(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Closes the innermost open element of `tags` and all inside it, unless it lies beyond one of `bounds`."""
        if not any(self.open.get(t) for t in tags):
            return
        at = self.node
        while at is not None and at.tag not in tags:
            if at.tag in bounds:
                return
            at = at.parent
        while at is not None and self.node is not at.parent:
            self.open[self.node.tag] -= 1
            self.silent -= self.node.tag in NO_TEXT
            if self.forms and self.forms[-1] is self.node:
                self.forms.pop()
            self.node = self.node.parent

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in ("html", "body"):
            return  # what follows belongs to the body
        if tag in INLINE:
            if not self.open.get(tag):
                return
            inner = self.node
            while inner.tag != tag and inner.parent is not None:
                inner = inner.parent
            if inner.name[0] or inner.bad and not (inner.parent and inner.parent.bad):
                self.cut()
        else:
            self.cut()
        bounds = frozenset(["table"]) if tag in TABULAR else BOUNDS | {"ul", "ol"} if tag == "li" else BOUNDS
        self._shut(frozenset([tag]), bounds - {tag})

    def handle_data(self, data: str) -> None:
        if self.node.tag == "head" and data.strip():
            self._shut(frozenset(["head"]), frozenset())
        if not self.silent:
            self.parts.append(data)


def parsed(html: str) -> tuple[list[tuple[str, int, Node]], list[Node]]:
    """Lines (text, tags, node), and all elements, each behind the one around it."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.lines, parser.nodes


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    n = len(values)
    out = []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        w = weights[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def clusters(ratios: list[float]) -> list[bool]:
    """True for lines above the threshold: half the mean ratio, by two-means between low and high when they lie far apart."""
    mean = sum(ratios) / len(ratios)
    low, high = min(ratios), max(ratios)
    for _ in range(20):
        mid = (low + high) / 2
        a, b = [r for r in ratios if r <= mid], [r for r in ratios if r > mid]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    threshold = min((low + high) / 2, mean) / 2
    return [r >= threshold for r in ratios]


def content_of(lines: list[tuple[str, int, Node]]) -> list[int]:
    """For each line its characters if it lies in a content cluster, else 0."""
    if not lines:
        return []
    ratios = smoothed([len(text) / tags for text, tags, _ in lines])
    return [len(text) * c for (text, _, _), c in zip(lines, clusters(ratios), strict=True)]


def named_above(nodes: list[Node]) -> list[Node | None]:
    """For each element the outermost one around it, or itself, that is named."""
    out: list[Node | None] = []
    for node in nodes:
        out.append(node.parent is not None and out[node.parent.number] or (node if node.name[0] else None))
    return out


def unnamed(lines: list[tuple[str, int, Node]], nodes: list[Node]) -> list[tuple[str, int, Node]]:
    """The lines outside elements that are named as boilerplate, after the names of those that hold the content are dropped."""
    content = content_of(lines)
    total = sum(content)
    while True:
        tops = named_above(nodes)
        held: dict[tuple[int, str], int] = {}
        headed = set()
        for (_, _, node), chars in zip(lines, content, strict=True):
            if top := tops[node.number]:
                held[top.name] = held.get(top.name, 0) + chars
                if node.headed:
                    headed.add(top.name)
        if not held:
            return lines
        most = max(held, key=held.__getitem__)
        free = total - sum(held.values())
        kind, mine = most[0], held[most]
        if kind == COMMENT:
            counts = not free and mine and most in headed
        elif kind == TOPIC:
            counts = 2 * mine > total
        else:
            counts = mine > 0 and (not free or mine >= NAME_SHARE * total)
        if not counts:
            if kind != TOPIC or free or not mine:
                return [line for line in lines if tops[line[2].number] is None]
        for node in nodes:
            if node.name == most:
                node.name = UNNAMED


def region(lines: list[tuple[str, int, Node]], nodes: list[Node]) -> set[Node]:
    """The main element or the articles with most of the text of the content clusters, else the smallest element that covers all clusters."""
    content = content_of(lines)
    for of in ("main", "article"):
        held: dict[Node, int] = {}
        for (_, _, node), chars in zip(lines, content, strict=True):
            if top := getattr(node, of):
                held[top] = held.get(top, 0) + chars
        if held and sum(held.values()) >= SHARE * sum(content):
            return set(held)
    covering = [node for (_, _, node), chars in zip(lines, content, strict=True) if chars] or [node for _, _, node in lines]
    below = [0] * len(nodes)
    for node in covering:
        below[node.number] += 1
    for node in reversed(nodes[1:]):
        below[node.parent.number] += below[node.number]
    at = covering[0]
    while below[at.number] < len(covering):
        at = at.parent
    while at.parent is not None and at.tag in PARTS:
        at = at.parent
    return {at}


def main_text(html: str | None) -> str:
    """The page's main text: its region's blocks, white space as one space, joined by one space."""
    lines, nodes = parsed(html or "")
    lines = unnamed([x for x in lines if not x[2].bad], nodes)
    if not lines:
        return ""
    top = region(lines, nodes)
    inside: list[bool] = []
    for node in nodes:
        inside.append(node in top or node.parent is not None and inside[node.parent.number])
    return " ".join(text for text, _, node in lines if inside[node.number])


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each row of pages: `key`, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (key, "url"))
    return pages.select(key, "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")
