"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser gives events; block tags cut the text into lines.
Each line has a ratio of characters to tags; lines of elements that are never content
(menus, forms, adverts by their class, ...) have ratio 0.  The ratios are smoothed by a
Gaussian along the page and parted into two clusters at their standard deviation.  The
upper cluster selects the region: sections that hold a line of it, with all their lines,
and what lies between two such lines.  Tags like ``article`` only break ties: where the
cluster has lines in and out of articles, the side with more characters stays, and short
sections stay in an article whose section is chosen.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, slices, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that only mark text inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never content.
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea option iframe svg canvas object audio video dialog menu".split())
#: Words of class, id and role that mark what is not content.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header topbar toolbar comment comments commentlist respond reply replies disqus discussion share sharing social related recommended newsletter subscribe subscription signup widget complementary contentinfo search login".split()
)
HEADERS = frozenset(["header", "masthead", "banner"])
#: Elements that part a page; a line belongs to the innermost one.
SECTIONS = frozenset("html body div section article main center td".split())
#: Elements of short lines that belong to the section around them, unless they are links.
LISTS = frozenset("ul ol dl table".split())
SIGMA = 1.0
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_texts = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
_hints: dict[str, frozenset] = {}


def _hinted(value: str) -> frozenset:
    if value not in _hints:
        if len(_hints) > 50_000:
            _hints.clear()
        _hints[value] = frozenset(x.lower() for x in _WORD.findall(value)) & HINTS
    return _hints[value]


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]  # numbers of the sections around it, the innermost last
    lists: bool  # in a list or table of its section
    article: bool
    alive: bool  # not in an element that is never content
    linked: int  # characters in links


class Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, never content, section number
        self.dead, self.articles, self.numbers, self.links = 0, 0, 0, 0
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            last = max((k for k, x in enumerate(self.open) if x[2]), default=-1)
            lists = any(x[0] in LISTS for x in self.open[last + 1 :])
            self.lines.append(Line(text, self.tags, tuple(n for _, _, n in self.open if n), lists, self.articles > 0, not self.dead, self.linked))
            self.tags = 0
        self.linked = 0
        self.parts.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag not in INLINE
        if block:
            self._flush()
        if tag in VOID:
            return
        bad = tag in NEVER or tag == "header" and not self.articles
        hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main", "h1"):
                found = _hinted(value)
                if self.articles:
                    found -= HEADERS
                bad |= bool(found)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", ""):
                hidden = True
        bad |= hidden
        if tag in ("article", "main") and not bad:
            self.articles += 1
        self.links += tag == "a"
        if tag in SECTIONS:
            self.numbers += 1
        self.open.append((tag, bad, self.numbers if tag in SECTIONS else 0))
        self.dead += bad

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        block = tag not in INLINE
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                break
            if name not in INLINE and name != "p" and (not block or tag == "p"):
                return  # an inline tag or paragraph doesn't close a container
        else:
            if block:
                self._flush()
            return
        if block:
            self._flush()
        for name, bad, _ in self.open[k:]:
            self.dead -= bad
            self.links -= name == "a"
            if name in ("article", "main") and not bad:
                self.articles -= 1
        del self.open[k:]

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends by the weights that there are."""
    one = np.convolve(np.ones(len(ratios)), _KERNEL)[3:-3]
    return np.convolve(ratios, _KERNEL)[3:-3] / one


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines are in the upper cluster."""
    score = smoothed(np.array([len(x.text) / max(x.tags, 1) if x.alive else 0.0 for x in lines]))
    return (score >= score.std()) & np.array([x.alive for x in lines], bool)


def region(lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Which lines the main text has, from the lines of the upper cluster."""
    size = np.array([len(x.text) for x in lines])
    within = np.array([x.article for x in lines], bool)
    if (content & within).any():  # a tie between articles and the rest of the page
        content = content & (within == (size[content & within].sum() >= size[content & ~within].sum()))
    own = [x.path[-1] if x.path else 0 for x in lines]
    chosen = {n for n, good in zip(own, content) if good}
    links: dict[int, list[int]] = {}  # by section: characters of its lists, and of links in them
    for x, n in zip(lines, own):
        if x.lists:
            sums = links.setdefault(n, [0, 0])
            sums[0] += len(x.text)
            sums[1] += x.linked
    plain = {n for n, (every, linked) in links.items() if 2 * linked < every}
    # a section of short lines in a chosen section is in doubt: inside of an article it stays
    held = [n in chosen or x.article and x.path[-2:-1] and x.path[-2] in chosen for x, n in zip(lines, own)]
    kept = np.array([x.alive and h and (not x.lists or n in plain) for x, n, h in zip(lines, own, held)], bool) | content
    # what lies between two kept lines of a section that holds both
    before = np.maximum.accumulate(np.where(kept, np.arange(len(kept)), -1))
    after = np.minimum.accumulate(np.where(kept, np.arange(len(kept)), len(kept))[::-1])[::-1]
    for k in np.flatnonzero(~kept & (before >= 0) & (after < len(kept))):
        around = lines[k].path[-2:-1]
        kept[k] = lines[k].alive and bool(around) and all(around[0] in lines[i].path[-2:] for i in (before[k], after[k]))
    return kept


def main_text(html: str) -> str:
    """The content lines of a page, joined by spaces; empty if there are none."""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    return " ".join(x.text for x, good in zip(lines, region(lines, clusters(lines))) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without content, have an empty text and n_chars 0.
    Rows are independent of each other: null ids, nulls in url and repeated rows are kept
    as they come, and an empty table gives no rows.
    """

    def run(batches):
        for batch in slices(batches):
            out = [main_text(x) if x else "" for x in texts(batch.column("html"))]
            yield batch_of(_texts, [batch.column("page_id"), batch.column("url"), out, [len(x) for x in out]])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
