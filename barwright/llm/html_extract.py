"""Main text from HTML by text-to-tag ratios.

The standard library's parser streams a page's events; block-level tags end lines. A line keeps its text, the number
of tags met since the line before, how much of its text is in links, and the container it lies in. Lines in elements
that HTML itself sets apart from main text (menus, footers, controls, scripts and so on) go first, but no element takes
more than it can mean: one that stays open gives its lines back, a form that wraps prose only loses its controls, and a
header without links counts like other lines. The ratio of text to tags is smoothed with a Gaussian over the lines and clustered by a threshold halfway between two means; class
names that hint at other parts lower a line's score, no more. The lines of the high cluster are the core. The content
region is the smallest container that holds nearly all of it, or the articles where a page has some; in it, hinted
containers go whose score is low, and so do containers without core that are lists of links or of short lines.
Everything else in the region stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles whose content is never main text.
ASIDE = frozenset("script style noscript template head title svg canvas iframe object audio video nav footer aside menu dialog form button select textarea datalist option".split())
#: Those that hold no text that shows, those that a block ends, and those that the parser may see no end of.
UNSEEN = frozenset("script style noscript template head title svg canvas iframe object audio video".split())
INLINE = frozenset("head title select datalist option".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul footer aside".split()
)
SECTIONS = frozenset("article main section div body td blockquote details figure".split())
ARTICLES = frozenset(("article", "main"))
STARTS = ARTICLES | {"section"}
#: Words of class, id and label that hint at other parts than main text, and words of wrappers that may hold them beside it.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social sidebar sidenav menu nav navbar navigation topnav breadcrumb breadcrumbs footer comment comments commentlist discussion disqus reply replies respond related recommended recommendations pagination pager".split()
)
WEAK = frozenset("foot header topbar masthead toolbar signup login search tags skip disclaimer label".split())
WRAPPERS = frozenset("content main article post page wrapper wrap container layout row body entry story has with no".split())
#: What a hint takes off a score (scores are logarithms of ratios); how far apart the clusters' means have to be.
STRONG_COST, WEAK_COST, GAP = 3.0, 1.0, 1.4
#: The share of the core that a region holds, and the lines that make a list.
REGION, LIST = 0.85, 3
#: Characters of prose that make a form or an outer article content, and those of a line of prose.
PROSE, SENTENCE = 200, 60
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the element isn't shown, or its role sets it aside."""
    return any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "role" and v in ROLES or n == "style" and v and re.search(r"display\s*:\s*none", v) for n, v in attrs)


def _cost(attrs: list[tuple[str, str | None]]) -> float:
    """What the element's names take off the scores of its lines."""
    cost = 0.0
    for name, value in attrs:
        if value and name in ("class", "id", "aria-label") or name == "itemtype" and value and "Comment" in value:
            words = set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
            if not words & WRAPPERS or any(w.startswith(("comment", "advert", "cookie")) for w in words):
                cost = max(cost, STRONG_COST * bool(words & STRONG), WEAK_COST * bool(words & WEAK))
    return cost


@dataclass
class Aside:
    """An element set aside: the one around it, its tag, whether it was closed, and what was seen in it."""

    around: int
    tag: str
    closed: bool = False
    links: int = 0
    article: bool = False
    section_at: int | None = None  # the line at which an article, main part or section first begins in it


class Lines(HTMLParser):
    """Collects a page's lines: (text, tags, characters in links, container's number, aside's number or 0).

    containers[i]: (parent's number, what its names take off, whether it is an article, whether it lies in one, its tag).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.containers: list[tuple[int, float, bool, bool, str]] = [(-1, 0.0, False, False, "")]
        self.asides = [Aside(0, "", True)]
        self.open: list[tuple[str, int, int, tuple[int, int] | None]] = []  # tag, container and aside around its content, counts to go on from
        self.links = 0
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections outside of XML are bogus comments."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.linked, *(self.open[-1][1:3] if self.open else (0, 0))))
                self.tags = self.linked = 0
            self.parts = []

    def chain(self, aside: int) -> Iterator[Aside]:
        """An aside and those around it."""
        while aside:
            yield self.asides[aside]
            aside = self.asides[aside].around

    def leave(self, tags: frozenset[str] | None) -> None:
        """Ends the asides of these tags (None: all but forms) here, wherever their end tags are."""
        out = {i for i, a in enumerate(self.asides) if i and (a.tag != "form" if tags is None else a.tag in tags)}
        if any(aside in out for *_, aside, _ in self.open):
            self.flush()
            for i, (tag, at, aside, counts) in enumerate(self.open):
                while aside in out:
                    self.asides[aside].closed = True
                    aside = self.asides[aside].around
                self.open[i] = (tag, at, aside, counts)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and self.open[-1][2]:
            if tag in BLOCKS or tag == "body":
                self.leave(INLINE)
            if tag == "main":
                self.leave(None)
            if tag in STARTS:
                self.flush()
                for a in self.chain(self.open[-1][2]):
                    a.article |= tag in ARTICLES
                    a.section_at = len(self.lines) if a.section_at is None else a.section_at
            elif tag == "a":
                for a in self.chain(self.open[-1][2]):
                    a.links += 1
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br" or tag == "img":
            self.parts.append(" ")
        if tag in VOID:
            return
        at, inner = self.open[-1][1:3] if self.open else (0, 0)
        inside = self.containers[at][3]
        whole = tag in ("html", "body")
        aside = tag in ASIDE or tag == "header" and not inside or not whole and tag not in ARTICLES and attrs and _hidden(attrs)
        aside = aside or tag in ("label", "legend") and any(a.tag == "form" for a in self.chain(inner))
        cost = _cost(attrs) if attrs and not whole else 0.0
        if (not aside or tag in ("form", "header")) and (tag in SECTIONS or cost or aside):
            self.containers.append((at, cost, tag in ARTICLES, inside or tag in ARTICLES, tag))
            at = len(self.containers) - 1
            if cost:
                self.flush()
        counts = None
        if aside:
            self.flush()
            counts = self.tags, self.linked
            self.asides.append(Aside(inner, tag))
            inner = len(self.asides) - 1
        self.open.append((tag, at, inner, counts))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                break
        else:
            return
        around = self.open[i - 1][1:3] if i else (0, 0)
        first = self.open[i]
        self.tags += 1
        if any(t in BLOCKS or (at, aside) != around for t, at, aside, _ in self.open[i:]):
            self.flush()
        if first[3]:
            if first[2] != around[1]:
                self.asides[first[2]].closed = True
            self.tags, self.linked = first[3][0] + 1, first[3][1]
        self.links = max(0, self.links - sum(t == "a" for t, *_ in self.open[i:]))
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def shown(self) -> list[tuple[str, int, int, int]]:
        """The lines (text, tags, characters in links, container's number) that no element sets aside."""
        self.flush()
        for lenient in (False, True):
            kept = [line[:4] for i, line in enumerate(self.lines) if not any(self._takes(a, i, lenient) for a in self.chain(line[4]))]
            if kept:
                break
        return kept

    def _takes(self, aside: Aside, line: int, lenient: bool) -> bool:
        """Whether a line goes with the aside it lies in; `lenient`: one that holds an article keeps its lines."""
        if aside.tag == "form":
            return not self._content(aside)
        if aside.tag in ("option", "label", "legend", "textarea", "button") or aside.tag in UNSEEN and aside.closed:
            return True
        if lenient and aside.article:
            return False
        if not aside.closed:
            return aside.section_at is not None and line < aside.section_at
        return aside.tag != "header" or aside.links > 0

    def _content(self, form: Aside) -> bool:
        """Whether a form wraps content: an article, prose, or most of what the page shows."""
        if form.article:
            return True
        if not hasattr(self, "forms"):
            self.forms: dict[int, tuple[int, int]] = {}
            self.shown_chars = 0
            for i, (text, _, linked, _, at) in enumerate(self.lines):
                around = list(self.chain(at))
                if not any(a.tag != "form" and self._takes(a, i, False) for a in around):
                    own = len(text) - linked
                    self.shown_chars += len(text)
                    for a in around:
                        prose, chars = self.forms.get(id(a), (0, 0))
                        self.forms[id(a)] = (prose + own * (own >= SENTENCE), chars + len(text))
        prose, chars = self.forms.get(id(form), (0, 0))
        return prose >= PROSE or 2 * chars > self.shown_chars


def ratios(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Characters outside of links for each tag before the line's end, as logarithms."""
    return np.log1p(np.array([max(0, len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines], np.float64))


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """x under a Gaussian of three sigma to each side, renormalised at the ends."""
    half = int(3 * sigma)
    g = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(x, g)[half : half + len(x)] / np.convolve(np.ones(len(x)), g)[half : half + len(x)]


def halfway(x: np.ndarray) -> float:
    """The threshold between two clusters of x: halfway between the means of what is below and above it.

    Values whose clusters' means lie closer than `GAP` are one cluster, the high one.
    """
    t, apart = float(x.mean()), 0.0
    for _ in range(20):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            break
        apart, new = float(high.mean()) - float(low.mean()), (float(low.mean()) + float(high.mean())) / 2
        if abs(new - t) < 1e-6:
            break
        t = new
    return t if apart >= GAP else -np.inf


def _without_replies(lines: list[tuple[str, int, int, int]], boxes: list[tuple[int, float, bool, bool, str]]) -> list[tuple[str, int, int, int]]:
    """The lines without those of articles inside of an article that has prose of its own, which HTML means for replies."""
    nested = [(0, 0)] * len(boxes)  # the outermost article around a container, and the one next inside it
    for i, (parent, *_, tag) in enumerate(boxes):
        if i:
            outer, inner = nested[parent]
            nested[i] = (outer, inner or i) if tag == "article" and outer else (i, 0) if tag == "article" else (outer, inner)
    if not any(inner for _, inner in nested):
        return lines
    own: dict[int, int] = {}
    for text, _, linked, at in lines:
        outer, inner = nested[at]
        key = inner or outer
        own[key] = own.get(key, 0) + len(text) - linked
    replies = {inner for outer, inner in nested if inner and (own.get(outer, 0) >= PROSE or own.get(outer, 0) >= own.get(inner, 0))}
    return [x for x in lines if nested[x[3]][1] not in replies]


def main_text(html: str, sigma: float = 1.0) -> str:
    """The page's main text: blocks trimmed, white space inside them single spaces, two newlines between them."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines, boxes = parser.shown(), parser.containers
    if any(boxes[at][3] for *_, at in lines):
        lines = _without_replies([x for x in lines if boxes[x[3]][3]], boxes)
    if not lines:
        return ""
    total_cost = [0.0] * len(boxes)
    for i, (parent, cost, *_) in enumerate(boxes):
        total_cost[i] = max(cost, total_cost[parent] if parent >= 0 else 0.0)
    score = smoothed(ratios(lines), sigma) - np.array([total_cost[at] for *_, at in lines])
    limit = halfway(score)
    core = score >= limit

    size, linked, chars, held, points = (np.zeros(len(boxes)) for _ in range(5))  # by container: core, links, text, lines, scores
    for (text, _, links, at), high, s in zip(lines, core, score, strict=True):
        size[at] += len(text) * high
        linked[at] += links
        chars[at] += len(text)
        held[at] += 1
        points[at] += s
    for i in range(len(boxes) - 1, 0, -1):
        for sums in (size, linked, chars, held, points):
            sums[boxes[i][0]] += sums[i]
    region = 0
    children: list[list[int]] = [[] for _ in boxes]
    for i, (parent, *_) in enumerate(boxes):
        if parent >= 0:
            children[parent].append(i)
    while not boxes[region][3] and (best := [c for c in children[region] if size[c] and size[c] >= REGION * size[0]]):
        region = best[0]

    kept = [False] * len(boxes)
    kept[region] = True
    for i in range(region + 1, len(boxes)):  # parents come before their children
        parent, cost, article, inside, _ = boxes[i]
        if kept[parent] and held[i]:
            if cost:
                kept[i] = points[i] / held[i] >= limit
            elif size[i]:
                kept[i] = True
            else:
                kept[i] = not article if inside else 2 * linked[i] <= chars[i] and held[i] < LIST
    menu = [not high and not boxes[x[3]][3] and 2 * x[2] > len(x[0]) for x, high in zip(lines, core, strict=True)]
    runs = [m and (menu[i - 1 : i] == [True] or menu[i + 1 : i + 2] == [True]) for i, m in enumerate(menu)]
    return "\n\n".join(text for (text, _, _, at), run in zip(lines, runs, strict=True) if kept[at] and not run)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """`pages` without the HTML column, plus text and n_chars: the whole page's main text, and its code points.

    Null or empty HTML, and pages without text that shows, give an empty text. An element that is never closed sets
    nothing aside but what comes before an article, main part or section in it; a page whose text would all be set
    aside keeps it. Repeated rows stay; an empty table gives none; columns named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) if h else "" for h in (x.as_py() for x in b.column(len(keep)))]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.string()), sizes], placed(len(keep) + 2))

    rows = texts(pages, *keep, html_col).toDF(*placed(len(keep) + 1))
    schema = rows.drop(rows.columns[-1]).schema.add(f"c{len(keep)}", "string").add(f"c{len(keep) + 1}", "long")
    return rows.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(texts(pages, "page_id", "url", "html"))
