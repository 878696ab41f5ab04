"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's HTML parser streams events; block elements cut the page into lines (the text of one block, the tags
since the line before, how much of it is links, and the container it stands in). A line's ratio is its characters, links
left out, over its tags, on a logarithmic scale, so that one endless line doesn't set the page's threshold. Ratios are smoothed with a Gaussian kernel over the lines' places in the page, where a change of
container counts as ``GAP`` more lines, so that a short line takes the level of the lines around it. Tags and names weigh
but never decide: a line inside elements that seldom hold article text counts for less, once when it is smoothed over and
once in its own score; inside article and main elements it counts for more.

Scores are clustered by a threshold, ``THRESHOLD`` x their standard deviation over the page: lines at or above it are the
seeds. A seed's region takes in the lines of its container, and those of the containers inside the same article or main
element, down to ``JOIN`` of the threshold, and headings that lead to it; what stays below (menus, adverts, notices, forms, link
lists, far-off short blocks) goes. As the threshold is relative, no page with text is left empty.

Defined results: null or empty html gives an empty text and n_chars 0; equal scores are kept or dropped together; character
references are decoded once; unclosed and stray tags are tolerated, and an article inside an unclosed menu is an article;
elements nested deeper than ``DEPTH`` count as their ancestor there; very long pages take time in proportion to their
length; repeated rows are extracted one by one; other columns, whatever their names, are not read. One pass, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.shared import mapped

#: HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template head title iframe object svg canvas button select option textarea datalist audio video map".split())
SELDOM = frozenset("nav aside footer form menu dialog fieldset".split())
UNITS = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main td nav aside footer header form menu dialog fieldset details figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that name what is seldom the article, and those that name a frame around everything.
_HINTS = "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget related recommended share sharing social footer header masthead topbar toolbar comment comments respond reply replies discussion disqus newsletter subscribe subscription signup login form search pagination pager tags complementary contentinfo"
HINTS = frozenset(_HINTS.split())
TALK = frozenset("comment comments reply replies respond discussion disqus related recommended promo teaser".split())
FRAMES = frozenset("page site layout wrap wrapper container outer inner main content body article post story entry has with no without is js".split())
_NAMES = re.compile(r"[A-Za-z]+")
_BLANK = re.compile(r"\s+")
SIGMA, GAP, THRESHOLD, JOIN, DEPTH = 1.5, 1.0, 0.5, 0.2, 2000
#: Weights: an element that is named or made for something else, one whose compound name has such a word, an article.
STRONG, SOFT, UNIT = 0.15, 0.5, 2.0


class _Events(HTMLParser):
    """Collects lines: text, tags, share of links, container, unit (number of the outermost article or main, 0: none), weight, whether a heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, whether without text, and the state before: container, unit, weight
        self.stack: list[tuple[str, bool, int, int, float]] = []
        self.silent = self.links = self.containers = self.units = 0
        self.container, self.unit, self.weight = 0, 0, 1.0
        self.open: dict[str, int] = {}
        self.beyond: dict[str, int] = {}
        self.lines: list[tuple] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.block = ""

    def flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, max(1, self.tags), min(1.0, self.linked / len(text)), self.container, self.unit, self.weight, self.block in HEADINGS))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in NO_TEXT:
            self.flush()
            self.block = tag
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if len(self.stack) >= DEPTH:
            self.beyond[tag] = self.beyond.get(tag, 0) + 1
            return
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and self.open.get(tag):
            self._implied(tag)
        silent = tag in NO_TEXT
        self.stack.append((tag, silent, self.container, self.unit, self.weight))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += silent
        self.links += tag == "a"
        if tag in CONTAINERS:
            self.containers += 1
            self.container = self.containers
        if tag in UNITS:
            if not self.unit:
                # what stands around an article (an unclosed menu, a frame named like a header) says nothing about it
                self.units += 1
                self.unit, self.weight = self.units, UNIT
            if any(not TALK.isdisjoint(x.lower() for x in _NAMES.findall(name)) for name in _names(attrs)):
                self.weight *= STRONG
        elif tag not in ("html", "body"):
            self.weight *= _weight(tag, attrs, bool(self.unit))

    def _implied(self, tag: str) -> None:
        """An open element of the same kind ends where the next begins, unless a list or table stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._close(i)
                return
            if name not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE and tag not in NO_TEXT:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in NO_TEXT:
            self.flush()
            self.block = ""
        if self.beyond.get(tag):
            self.beyond[tag] -= 1
            return
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def _close(self, i: int) -> None:
        for tag, silent, container, unit, weight in reversed(self.stack[i:]):
            self.silent -= silent
            self.links -= tag == "a"
            self.open[tag] -= 1
            self.container, self.unit, self.weight = container, unit, weight
        del self.stack[i:]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def _names(attrs: list) -> set[str]:
    """The class names, id and role of an element, in lower case."""
    return {x.lower() for k, v in attrs if k in ("class", "id", "role") and v for x in v.split()}


def _weight(tag: str, attrs: list, inside: bool) -> float:
    if tag in SELDOM or tag == "header" and not inside:
        return STRONG
    out = 1.0
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return STRONG
    for name in _names(attrs):
        words = [x.lower() for x in _NAMES.findall(name)]
        if HINTS.isdisjoint(words):
            continue
        # "comments" or "site-footer" say what an element is, "with-sidebar" or "header-wrap" what is around it
        out = min(out, SOFT if not FRAMES.isdisjoint(words) and words[-1] not in HINTS or words[0] in ("with", "has", "no", "without") else STRONG)
    return out


def smoothed(values: np.ndarray, places: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means of the values by their places (ascending, one or more apart)."""
    got, weight = values.astype(float).copy(), np.ones(len(values))
    for d in range(1, min(len(values) - 1, math.ceil(3 * sigma)) + 1):
        k = np.exp(-(((places[d:] - places[:-d]) / sigma) ** 2) / 2)
        got[:-d] += k * values[d:]
        got[d:] += k * values[:-d]
        weight[:-d] += k
        weight[d:] += k
    return got / weight


def content(lines: list[tuple], smooth=smoothed) -> np.ndarray:
    """Which lines are content."""
    n = len(lines)
    size, tags, linked = np.array([len(x[0]) for x in lines], float), np.array([x[1] for x in lines], float), np.array([x[2] for x in lines])
    container, unit, weight, heading = np.array([x[3] for x in lines]), np.array([x[4] for x in lines]), np.array([x[5] for x in lines]), np.array([x[6] for x in lines])
    ratio = np.log1p(size * (1 - linked) / tags)
    places = np.cumsum(np.concatenate([[0.0], 1 + GAP * (container[1:] != container[:-1])]))
    score = weight * smooth(weight * ratio, places)
    limit = THRESHOLD * score.std()
    seed = score >= max(limit, 1e-12) if score.max() > 0 else np.ones(n, bool)
    # a region is a container, or an article or main element as a whole
    region = np.where(unit > 0, -unit, container)
    near = np.isin(region, region[seed]) & (score >= JOIN * limit)
    # lines of a region that weigh far less than its best stay out unless they are seeds themselves
    _, place = np.unique(region, return_inverse=True)
    best = np.zeros(n)
    np.maximum.at(best, place[seed], weight[seed])
    near &= weight >= 0.3 * best[place]
    keep = seed | near
    for i in range(n - 2, -1, -1):
        if heading[i] and keep[i + 1] and weight[i] >= 0.3 * weight[i + 1] and linked[i] < 1:
            keep[i] = True
    return keep


def main_text(html: str | None, smooth=smoothed) -> str:
    """The lines of the content regions, in page order, joined by an empty line."""
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    events.flush()
    if not events.lines:
        return ""
    keep = content(events.lines, smooth)
    return "\n\n".join(x[0] for x, k in zip(events.lines, keep.tolist(), strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    df = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(df, step, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
