"""Operator 8: the main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, table

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea svg math iframe object canvas audio video head title button select datalist dialog".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr td th blockquote div section article main body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption summary address".split())  # elements that are text themselves
FRAME = FLOW | frozenset("ul ol dl table tbody thead tfoot tr td th figure details".split())  # or order it

#: A weak prior on ratios: what an element's name, or a word of its class or id, multiplies the ratios below it by.
ELEMENT_PRIOR = {"nav": 0.0, "menu": 0.0, "header": 0.25, "footer": 0.25, "aside": 0.25, "form": 0.25, "article": 1.5, "main": 1.5}
WORD_PRIOR = {
    **dict.fromkeys("ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar comment comments disqus cookie cookies newsletter related share sharing social".split(), 0.25),
    **dict.fromkeys("article content post story code highlight quote pull pullquote caption lead".split(), 1.25),
}
#: Classes and ids that name an article, as a whole, and elements that are beside one.
WHOLE = frozenset("article content post story entry".split())
BESIDE = frozenset("header footer aside nav menu".split())
KINDS = frozenset("section article".split())  # elements that may part an article
SHARE = 0.75  # of an element's content that one child must hold for the rest to be left
LEAST = 0.65  # of the mean score, below which a path is no content

_STOP = re.compile("[>\"']")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none)", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Block:
    """A block's text as read, its element, and how much of it stands in links."""

    node: int
    text: str
    linked: int


@dataclass
class Page:
    """Block elements in order: parent, name and tag path of each (0: the page itself), and their texts.

    A tag path is what its elements' names and classes are from the root down; paths are numbered, prior is theirs.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    prior: list[float] = field(default_factory=lambda: [1.0])
    named: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])  # of each path's last element the whole classes and ids
    words: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])  # and the words in them
    blocks: list[Block] = field(default_factory=list)


class _Tags:
    """Where tags end. A quote that never closes is a character like any other; no place is looked at twice in vain."""

    def __init__(self, page: str) -> None:
        self.page, self.vain = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, from a place within it on; -1 if there is none."""
        seen = []
        while at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            at = m.start()
            if m[0] == ">":
                return at
            if at in self.vain:
                break
            seen.append(at)
            at = self.page.find(m[0], at + 1) + 1 if at < self.last[m[0]] else at + 1
        self.vain.update(seen)
        return -1


def read(page: str, priors: bool = True) -> Page:
    """The blocks of a page in order, references decoded and white space collapsed; none from opaque or hidden elements."""
    out, tags = Page(), _Tags(page)
    paths: dict[tuple[int, str], int] = {}
    stack = [0]  # open block elements
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    text: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.blocks.append(Block(stack[-1], whole, linked))
        text, linked = [], 0

    def pop() -> None:
        opened[out.name[stack.pop()]] -= 1

    def push(name: str, attributes: str) -> None:
        named = " ".join(x for groups in _NAMED.findall(attributes) for x in groups if x) if attributes else ""
        words = sorted({w.lower() for w in _PARTS.findall(named)})
        key = (out.path[stack[-1]], ".".join((name, *words)))
        if key not in paths:
            paths[key] = len(out.prior)
            own = math.prod({ELEMENT_PRIOR.get(name, 1.0), *(WORD_PRIOR.get(w, 1.0) for w in words)}) if priors and name not in ("html", "body") else 1.0
            out.prior.append(out.prior[key[0]] * own)
            out.named.append(frozenset(named.lower().split()) if priors else frozenset())
            out.words.append(frozenset(words) if priors else frozenset())
        out.parent.append(stack[-1])
        out.name.append(name)
        out.path.append(paths[key])
        stack.append(len(out.name) - 1)
        opened[name] += 1

    def skip(name: str, at: int) -> int:
        """The place after the end of an element that nothing is read from; of one that never ends, the page's end."""
        stop = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
        if stop:
            return stop.end()
        unclosed.add(name)
        return at if name in ("head", "title") else len(page)

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start != at:
            run = page[at : start if start >= 0 else end]
            text.append(run)
            linked += len(run) if links else 0
            at += len(run)
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            text.append(page[at + 9 : stop if stop >= 0 else end])
            at = stop + 3 if stop >= 0 else end
            continue
        m = _NAME.match(page, at)
        stop = tags.end(m.end()) if m else page.find(">", at) if page[at + 1 : at + 2] in ("!", "?") and at < tags.last[">"] else -1
        if stop < 0:  # no tag, or one that never ends, is text
            text.append("<")
            at += 1
            continue
        attributes, at = page[m.end() : stop] if m else "", stop + 1
        if m is None:
            continue
        closing, name = m[1], m[2].lower()
        if name == "br":
            text.append(" ")
        elif name == "hr":
            close()
        elif name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else 1
        elif name in OPAQUE:
            if not closing and not attributes.endswith("/"):
                at = skip(name, at)
        elif name not in VOID:
            close()
            links = 0
            if closing:
                if opened[name]:
                    while out.name[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if out.name[stack[-1]] == "p":  # a paragraph ends where the next block begins
                pop()
            for _ in range(8):
                if len(stack) > 1 and out.name[stack[-1]] in CLOSES.get(name, ()):
                    pop()
                elif len(stack) > 2 and out.name[stack[-1]] not in HOLDS and out.name[stack[-2]] in CLOSES.get(name, ()):
                    pop()
                else:
                    break
            if not attributes.endswith("/"):
                push(name, attributes)
                if attributes and _HIDDEN.search(attributes):
                    at = _after(page, name, at, tags, unclosed)
                    pop()
    close()
    return out


def _after(page: str, name: str, at: int, tags: _Tags, unclosed: set[str]) -> int:
    """The place after an element's own end, elements of its name within it counted; where it has none, it ends at once."""
    depth, begun, each = 1, at, re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)
    while name not in unclosed and (m := each.search(page, at)):
        stop = tags.end(m.end())
        if stop < 0:
            break
        depth += -1 if m[1] else 1
        at = stop + 1
        if not depth:
            return at
    unclosed.add(name)
    return begun


def _marks(text: str) -> int:
    return sum(unicodedata.category(c)[0] == "P" for c in text) if not text.isascii() else len(_ASCII_MARKS.findall(text))


_ASCII_MARKS = re.compile(r"[!-#%-*,-/:;?@\[-\]_{}]")


def scores(page: Page, sigma: float = 1.0) -> list[float]:
    """For each tag path how much it looks like content.

    The text length (without links) and punctuation of a path's blocks are summed; its ratio is the product of their
    means, as logarithms, less what stands in links, times the path's prior. Ratios are smoothed by a Gaussian along the
    page's blocks, and a path's smoothed mean is fused with its own ratio, which counts twice.
    """
    n = [0] * len(page.prior)
    length, linked, marks = n.copy(), n.copy(), n.copy()
    for b in page.blocks:
        p = page.path[b.node]
        n[p] += 1
        length[p] += max(0, len(b.text) - b.linked)
        linked[p] += min(b.linked, len(b.text))
        marks[p] += _marks(b.text)
    ratio = [math.log1p(x / k) * math.log1p(1 + m / k) * x / max(1, x + y) * w if k else 0.0 for k, x, y, m, w in zip(n, length, linked, marks, page.prior, strict=True)]
    own = [ratio[page.path[b.node]] for b in page.blocks]
    kernel = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-2, 3)}
    smooth = [0.0] * len(n)
    for i, b in enumerate(page.blocks):
        near = [(k, own[i + d]) for d, k in kernel.items() if 0 <= i + d < len(own)]
        smooth[page.path[b.node]] += sum(k * v for k, v in near) / sum(k for k, _ in near)
    return [(r * r * s / k) ** (1 / 3) if k else 0.0 for r, s, k in zip(ratio, smooth, n, strict=True)]


def _added(page: Page, weigh: Callable[[Block], float]) -> list[float]:
    """Of each element the weight of all blocks in it."""
    weight = [0.0] * len(page.name)
    for b in page.blocks:
        weight[b.node] += weigh(b)
    for k in range(len(weight) - 1, 0, -1):  # children come after their parents
        weight[page.parent[k]] += weight[k]
    return weight


def branches(page: Page, weight: list[float]) -> tuple[list[bool], list[bool]]:
    """Of each element whether it is beside the article by a name of its branch, and whether it is in one by name.

    A class or id that is such a name as a whole (comments) says so for all that is in it; a word in one (with-sidebar),
    or an element such as footer, only where no article is inside, and an article is elsewhere or the branch does not hold
    SHARE of the page. A header within an article is part of it.
    """
    n = len(page.name)
    against = frozenset(w for w, p in WORD_PRIOR.items() if p < 1)
    named = lambda k: page.named[page.path[k]]
    words = lambda k: page.words[page.path[k]]
    whole = [k > 0 and page.name[k] not in ("html", "body") and (page.name[k] in ("article", "main") or bool(named(k) & WHOLE)) and not words(k) & against for k in range(n)]
    holds = whole.copy()
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] = holds[page.parent[k]] or holds[k]
    beside, within = [False] * n, [False] * n
    for k in range(1, n):
        up, name = page.parent[k], page.name[k]
        within[k] = within[up] or whole[k]
        if name in ("html", "body"):
            continue
        weak = (name in BESIDE and not (name == "header" and within[up])) or bool(words(k) & against)
        beside[k] = beside[up] or bool(named(k) & against) or (weak and not holds[k] and (holds[0] or weight[k] < SHARE * weight[0]))
    return beside, within


def main_text(page: str | None, priors: bool = True) -> str:
    """The article of a page: its content blocks joined by a space.

    Each block weighs its path's score (see scores) times its length without links. Branches whose names say that they
    are beside an article (see branches) only compete if nothing else has text. From the page down, the one child
    that holds SHARE of an element's weight is followed, as long as there is one and it is no text element; what stands
    beside it is left, unless it is a section of the same kind with content. In the element so found, a path is content if
    its score reaches LEAST of the mean (by weight and score). Other text elements (headings, short items) belong to it if
    they stand in it, or in an element with such paths, by themselves and not in links; between two content blocks also those
    whose names are of content, and items in an article that are links. priors=False does without names and classes. Null,
    empty or broken pages give what can be read, or ''.
    """
    read_ = read(page or "", priors)
    score = scores(read_)
    of = lambda b: score[read_.path[b.node]]
    weigh = lambda b: of(b) * max(0, len(b.text) - b.linked)
    beside, within = branches(read_, _added(read_, weigh)) if priors else ([False] * len(read_.name),) * 2
    if all(beside[b.node] or not weigh(b) for b in read_.blocks):
        beside = [False] * len(read_.name)
    read_.blocks = [b for b in read_.blocks if not beside[b.node]]
    weight = _added(read_, weigh)
    heaviest: dict[int, int] = {}
    alike: Counter[tuple[int, int]] = Counter()  # sections of one kind in an element that have content
    for k in range(len(weight) - 1, 0, -1):
        up = read_.parent[k]
        if up not in heaviest or weight[k] >= weight[heaviest[up]]:
            heaviest[up] = k
        if weight[k] > 0 and read_.name[k] in KINDS:
            alike[up, read_.path[k]] += 1
    if weight[0] <= 0:
        return ""
    holder = 0
    while (k := heaviest.get(holder)) is not None and weight[k] >= SHARE * weight[holder] and read_.name[k] not in FLOW and alike[holder, read_.path[k]] < 2:
        holder = k
    inside = [k == holder for k in range(len(weight))]
    home = list(range(len(weight)))  # the nearest element around a text element that is none, or the holder
    for k in range(1, len(weight)):
        inside[k] = inside[k] or inside[read_.parent[k]]
        if inside[k] and k != holder and read_.name[k] in FRAME:
            home[k] = home[read_.parent[k]]
    found = [b for b in read_.blocks if inside[b.node]]
    least = LEAST * sum(weigh(b) * of(b) ** 2 for b in found) / sum(weigh(b) * of(b) for b in found)
    strong = {home[b.node] for b in found if of(b) >= least} | {holder}

    content = [i for i, b in enumerate(found) if of(b) >= least]

    def belongs(i: int, b: Block) -> bool:
        if of(b) >= least:
            return True
        plain = 2 * b.linked <= len(b.text) or read_.name[b.node] in HEADINGS
        there, framed = read_.prior[read_.path[b.node]] > 0 and home[b.node] in strong, read_.name[b.node] in FRAME
        if there and framed and plain:
            return True
        between = bool(content) and content[0] < i < content[-1]
        own = read_.words[read_.path[b.node]]
        return between and ((there and framed and within[b.node]) or (plain and any(WORD_PRIOR.get(w, 1) > 1 for w in own)))

    return " ".join(b.text for i, b in enumerate(found) if belongs(i, b))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    Null and empty html give an empty text; null page_ids and urls stay null; repeated rows stay repeated; further columns
    are not looked at; an empty table gives an empty result.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            texts = pa.array([main_text(x.as_py()) for x in some.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), texts], names=["page_id", "url", "text"])

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by extract(), which says what null and repeated rows give."""
    return extract(table(spark, sf_dir, "pages"))
