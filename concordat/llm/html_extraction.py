"""Operator 7: main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser cuts a page into lines, one per block element, each with its characters, its
tags and its link characters. The text-to-tag ratio per line is smoothed with a Gaussian over neighbouring lines and
split by threshold clustering (two means in one dimension) into content and other lines, on every page. Element names and
class words of menus, headers, footers, side bars, notices, adverts, forms and comments only lower the ratio of the lines
in them, to 0; such a line has to pass the threshold by its own ratio, not by its neighbours'. (Scripts and styles are no
lines.) A class word on a wrapper counts for nothing: an element named by its class, id or role, or a form, with
``WRAPPER`` characters or more and next to no text of the page beside it.

The regions of content lines are widened by structure. If most of their characters stand in marked articles (``article``
or ``main``), they widen to all article elements, short lines included, and what is outside goes. Otherwise they widen to
the other lines of the elements that hold them, and the text runs from the first to the last such line, without lines that
are mostly links. Lowered lines below the threshold stay out.

Edge cases: null or empty html gives an empty text; broken markup never fails: marked sections are comments that end at
the next ``>``, an open comment takes the rest of the page, an article's start ends an advert left open; text outside any
block counts as a line. Extra columns are ignored; repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Element names and class words by role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe svg canvas "
    "object dialog menu audio video map".split()
)
HOLDER = frozenset("article body dd div li main section td".split())
UNSEEN = frozenset("script style noscript template head title iframe svg canvas object audio video map".split())
WRAPPING = frozenset("div section form table tbody tr td ul ol li span center main".split())
WRAPPER, BESIDE = 500, 0.1  # characters that a wrapper holds at least, and the share of them beside it at most
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs footer sidebar widget widgets related recommended share sharing social cookie cookies "
    "consent notice alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies respond pagination pager copyright legal masthead topbar toolbar".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters in links
    article: int  # number of the article, or 0
    holder: int  # number of the element that holds it
    low: tuple[int, ...]  # numbers of the boilerplate elements that it stands in, outermost first


class Lines(HTMLParser):
    """Collects the lines of a page, and which of its boilerplate elements may be wrappers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.ending = False
        self.holders: list[tuple[str, int]] = [("", 0)]  # open elements that hold lines, with their numbers
        self.open: Counter[str] = Counter()
        self.numbers = 0
        self.buffer: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.skip: list = []  # [tag, depth of the same tag] of an open element that has no lines
        self.low: list[list] = []  # [tag, depth of the same tag, may an article end it, number] of open boilerplate elements
        self.wrapping: set[int] = set()
        self.article = self.articles = self.article_depth = 0

    def close(self) -> None:
        self.ending = True
        super().close()
        self.flush()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self._upto(">", i + 3)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._upto("-->", i + 4)

    def _upto(self, mark: str, i: int) -> int:
        at = self.rawdata.find(mark, i)
        return at + len(mark) if at >= 0 else len(self.rawdata) if self.ending else -1

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), self.article, self.holders[-1][1], tuple(x[3] for x in self.low)))
        self.buffer, self.tags, self.links = [], 0, 0

    def hold(self, tag: str) -> None:
        self.numbers += 1
        self.open[tag] += 1
        self.holders.append((tag, self.numbers))

    def release(self, tag: str) -> None:
        while self.open[tag]:
            last = self.holders.pop()[0]
            self.open[last] -= 1
            if last == tag:
                return

    def boilerplate(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED or tag == "header" and not self.article:
            return True
        for name, value in attrs:
            v = (value or "").lower()
            if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not BOILERPLATE.isdisjoint(_SPLIT.split(v)):
                return True
            if name == "role" and v in ROLES or name == "hidden" or name == "aria-hidden" and v == "true":
                return True
            if name == "style" and _HIDDEN.search(v):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            self.skip[1] += tag == self.skip[0]
            return
        if tag in ("article", "main") and self.low and self.low[-1][2]:
            self.flush()
            self.low.clear()
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        if tag in UNSEEN:
            self.skip = [tag, 1]
            return
        if self.boilerplate(tag, attrs):
            words = " ".join(v or "" for n, v in attrs if n in ("class", "id")).lower()
            self.flush()
            self.numbers += 1
            self.low.append([tag, 1, tag != "aside" and not re.search("comment|repl|respond|disqus|related|recommend", words), self.numbers])
            if tag in WRAPPING:
                self.wrapping.add(self.numbers)
        elif self.low:
            self.low[-1][1] += tag == self.low[-1][0]
        if tag in HOLDER:
            self.hold(tag)
        if tag in ("article", "main"):
            self.article_depth += 1
            if self.article_depth == 1:
                self.articles += 1
                self.article = self.articles
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.skip:
            if tag in BLOCK:
                self.flush()
            self.tags += 1
            if tag == "br":
                self.buffer.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip[1] -= tag == self.skip[0]
            if not self.skip[1] or tag in ("body", "html") and self.skip[0] != "script":
                self.skip = []
            return
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.low and tag == self.low[-1][0]:
            self.low[-1][1] -= 1
            if not self.low[-1][1]:
                self.flush()
                self.low.pop()
        elif tag in ("body", "html"):
            self.low.clear()
        if tag in HOLDER:
            self.release(tag)
        if tag in ("article", "main") and self.article_depth:
            self.article_depth -= 1
            if not self.article_depth:
                self.article = 0
        if tag == "a" and self.in_link:
            self.in_link -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)
            if self.in_link:
                self.links += len(data)


def lowered(lines: list[Line], wrapping: set[int]) -> np.ndarray:
    """Which lines stand in a boilerplate element that isn't a wrapper; wrappers are found from the outermost element on."""
    size = [len(x.text) - x.links for x in lines]
    through: set[int] = set()
    for e in sorted({n for x in lines for n in x.low}):
        if e not in wrapping:
            continue
        own = beside = article = 0
        for x, n in zip(lines, size, strict=True):
            rest = [y for y in x.low if y not in through]
            if rest == [e]:
                own += n
            elif not rest:
                beside += n
                article += bool(x.article)
        if own >= WRAPPER and beside <= BESIDE * own and not article:
            through.add(e)
    return np.array([any(y not in through for y in x.low) for x in lines], bool)


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, normalised at the borders."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    cut = slice(r, r + len(ratio))
    return np.convolve(ratio, kernel)[cut] / np.convolve(np.ones(len(ratio)), kernel)[cut]


def two_means(x: np.ndarray) -> float:
    """The threshold between the two clusters of a one-dimensional 2-means; 0 if they lie within 1."""
    lo = float(x.min())
    hi = float(x.max())
    for _ in range(30):
        cut = (lo + hi) / 2
        a, b = x[x <= cut], x[x > cut]
        if not len(b) or (a.mean(), b.mean()) == (lo, hi):
            break
        lo, hi = float(a.mean()), float(b.mean())
    return (lo + hi) / 2 if hi - lo >= 1 else 0.0


def main_text(html: str, sigma: float = 1.0, threshold: Callable[[np.ndarray], float] = two_means) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    low = lowered(lines, parser.wrapping)
    ratio = np.log1p(np.array([max(0, len(x.text) - x.links) / (1 + x.tags) for x in lines], float) * ~low)
    smooth = smoothed(ratio, sigma)
    cut = threshold(smooth)
    passed = ~low | (ratio > cut)  # lines that a region may take in
    content = (smooth > cut) & passed
    if not content.any():  # the upper cluster lies between lines of text only
        content = passed
    inside = sum(len(x.text) for x, c in zip(lines, content, strict=True) if c and x.article)
    outside = sum(len(x.text) for x, c in zip(lines, content, strict=True) if c and not x.article)
    if inside and inside >= outside:
        return "\n".join(x.text for x, p in zip(lines, passed, strict=True) if p and x.article)
    held = {x.holder for x, c in zip(lines, content, strict=True) if c}
    own = [p and 2 * x.links <= len(x.text) for x, p in zip(lines, passed, strict=True)]
    at = [i for i, x in enumerate(lines) if own[i] and x.holder in held] or np.flatnonzero(content).tolist()
    return "\n".join(x.text for x, keep in zip(lines[at[0] : at[-1] + 1], own[at[0] : at[-1] + 1], strict=True) if keep) if at else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
