"""Content regions of web pages by text-to-tag ratios.

The events of the standard library's parser are taken as they stream: text
outside of scripts, styles and the like is counted for the line that is open,
and every tag counts against it. A line ends at a line feed of the source and
where an element that is set as a block begins or ends, so that pages
without line feeds have lines too. A line's ratio is its characters by its tags
(one at least). Ratios are smoothed by a Gaussian, and lines whose smoothed ratio
reaches the threshold, found by clustering the logarithms of the smoothed
ratios into two around means, are content.

The head ends at its end tag, at text of its own or at the first tag that no head has, an svg at the first
block in it, since these end tags may be left out. Where a noscript, template, svg or head is never closed, the
page is read once more with that tag hiding nothing, so that the rest of the page isn't lost with it;
an unclosed script or style takes the rest with it, as in browsers.

Nulls and empty pages have no lines and an empty text. Other broken markup is read as
the parser reads it; pages are read whole, very long ones in parts of FEED characters; each row is taken by itself, so ties
and repeated rows need nothing. An empty table gives an empty result; other
columns are ignored. Equal ratios on all lines: all are content.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
FEED = 1 << 16
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg head".split())
#: Elements that may stand in a head, and those whose text the parser itself takes up to the end tag.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset(["script", "style"])


class Lines(HTMLParser):
    """Text and number of tags of each line of a page."""

    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        """shown: start tags, by their number in the page, that hide nothing."""
        super().__init__(convert_charrefs=True)
        self.shown = shown
        self.text: list[str] = []
        self.tags: list[int] = []
        self.open: list[str] = []
        self.count = self.seen = 0
        self.hidden: list[tuple[str, int]] = []
        self.title = False

    def cut(self) -> None:
        line = " ".join("".join(self.open).split())
        if line or self.count:
            self.text.append(line)
            self.tags.append(self.count)
        self.open, self.count = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        if tag == "body":
            self.hidden.clear()
        elif self.hidden and (self.hidden[-1][0] == "head" and tag not in HEAD or self.hidden[-1][0] == "svg" and tag in BLOCKS and tag != "title"):
            self.hidden.pop()
        if tag in HIDDEN and (self.seen not in self.shown or tag in RAW):
            self.hidden.append((tag, self.seen))
        self.title = tag == "title"
        if tag in BLOCKS:
            self.cut()
        self.count += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self.cut()
        self.count += 1

    def handle_endtag(self, tag: str) -> None:
        for i, (name, _) in enumerate(self.hidden):
            if name == tag:
                del self.hidden[i:]
                break
        self.title = False
        self.count += 1
        if tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if self.hidden and self.hidden[-1][0] == "head" and not self.title and data.strip():
            self.hidden.pop()
        if self.hidden:
            return
        first, *more = data.split("\n")
        self.open.append(first)
        for part in more:
            self.cut()
            self.open.append(part)


def lines(html: str) -> tuple[list[str], list[int]]:
    """Text and number of tags of each line of a page; read again if an element that hides its content is left open."""
    shown: frozenset[int] = frozenset()
    while True:
        page = Lines(shown)
        for i in range(0, len(html), FEED):
            page.feed(html[i : i + FEED])
        page.close()
        page.cut()
        lost = [k for tag, k in page.hidden if tag not in RAW]
        if not lost:
            return page.text, page.tags
        # The second time all of them are shown that may be left open, so there is no third.
        shown = frozenset(lost) if not shown else frozenset(range(page.seen + 1))


def smooth(ratio: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Weighted means by a Gaussian of so many lines around; at the ends, of those there are."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(ratio, kernel)[radius : radius + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]


def threshold(x: np.ndarray) -> float:
    """Midpoint of the means of two clusters, by Lloyd's iterations from the extremes."""
    low, high = float(x.min()), float(x.max())
    for _ in range(100):
        middle = (low + high) / 2
        below = x < middle
        if not below.any():
            return low
        new = float(x[below].mean()), float(x[~below].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str) -> tuple[str, int, int]:
    """Content text (a line feed between lines), lines, content lines."""
    text, tags = lines(html)
    if not text:
        return "", 0, 0
    smoothed = smooth(np.array([len(t) for t in text]) / np.maximum(np.array(tags), 1))
    # Lengths of lines spread over orders of magnitude, so the clusters are those of the logarithms.
    scale = np.log1p(smoothed)
    content = scale >= threshold(scale) - 1e-9
    return "\n".join(t for t, c in zip(text, content) if c and t), len(text), int(content.sum())


def content_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines, content_lines) of every page."""

    @F.arrow_udf("struct<text:string,n_lines:int,content_lines:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            rows = [extract(h.as_py() or "") for h in html]
            text, lines, content = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(text, pa.string()), pa.array(lines, pa.int32()), pa.array(content, pa.int32())], ["text", "n_lines", "content_lines"]
            )

    return pages.select(F.col(id_col), run(F.col(html_col)).alias("x")).select(id_col, "x.*")
