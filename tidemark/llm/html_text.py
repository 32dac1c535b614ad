"""Main text of web pages by the text-to-tag ratio of their lines.

A streaming parser (the standard library's) turns a page into lines: every
block-level element begins and ends one. Lines of menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, which markup
names, are never content. The rest is grouped into regions: an article or main
element each, or else the innermost division that a line stands in.

Each line has a text-to-tag ratio (characters per tag, its own block one), the ratios of the page are
smoothed with a Gaussian, and two clusters of smoothed ratios set the threshold
between content and other lines. A region is content if its densest line reaches
the threshold; the best region always is. Article and main elements go before
other regions. All lines of a content region stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Elements by what the language says of them.
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody
    td tfoot th thead title tr ul""".split()
)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video select textarea button title".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_ARTICLES = frozenset("article main".split())
_DIVISIONS = frozenset("body center details div section td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of class and id names that mark what is no content.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices
    popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor
    sponsored subscribe toolbar widget""".split()
)
#: End tags that may be missing: a start tag closes an open element of these.
_CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
    "p": frozenset({"p"}),
    "body": frozenset({"head"}),
}

SMOOTHING = 1.0
_NAMES = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    text: str
    tags: int
    region: int
    in_article: bool


class _Lines(HTMLParser):
    """Lines of a page from parser events, each with the tags inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: element, whether it hides its content, whether it is an article, the region around it
        self._open: list[tuple[str, bool, bool, int]] = []
        self._hidden = 0
        self._articles = 0
        self._region = self._regions = 0
        self._text: list[str] = []
        self._tags = 1

    def _end_line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.lines.append(Line(text, self._tags, self._region, self._articles > 0))
        self._tags = 1

    def _hides(self, tag: str, attributes: list[tuple[str, str | None]]) -> bool:
        if tag in _HIDDEN or tag in _ASIDE or (tag == "header" and not self._articles):
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attributes:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and name == "role" and value.strip().lower() in _ROLES:
                return True
            if value and name in ("class", "id"):
                marks = _MARKS.intersection(_NAMES.findall(value.lower()))
                if marks and not (tag == "article" or tag == "main") or "comment" in marks or "comments" in marks:
                    return True
        return False

    def _close(self, place: int) -> None:
        self._region = self._open[place][3]
        for _, hides, article, _ in self._open[place:]:
            self._hidden -= hides
            self._articles -= article
        del self._open[place:]

    def _tag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end_line()
        elif not self._hidden:
            self._tags += 1
            if tag == "br":
                self._text.append("\n")

    def parse_html_declaration(self, i):
        # A marked section that the parser refuses is a comment in HTML.
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attributes):
        self._tag(tag)
        if tag in _EMPTY:
            return
        if tag in _CLOSES:
            for place in range(len(self._open) - 1, -1, -1):
                own = self._open[place][0]
                if own in _CLOSES[tag]:
                    self._close(place)
                elif own in _BLOCKS and own not in ("p",):
                    break
        hides = self._hides(tag, attributes)
        article = not self._hidden and not hides and tag in _ARTICLES
        around = self._region
        if article or (tag in _DIVISIONS and not self._articles):
            self._regions += 1
            self._region = self._regions
        self._articles += article
        self._hidden += hides
        if hides or tag in _BLOCKS:
            self._open.append((tag, hides, article, around))

    def handle_startendtag(self, tag, attributes):
        self._tag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._end_line()
        for place in range(len(self._open) - 1, -1, -1):
            if self._open[place][0] == tag:
                self._close(place)
                break
            if self._open[place][0] in _ARTICLES | _ASIDE and tag in ("p", "div", "span", "li"):
                break

    def handle_data(self, data):
        if not self._hidden:
            self._text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def page_lines(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    return parser.finish()


def smoothed(ratios: np.ndarray, width: float = SMOOTHING) -> np.ndarray:
    """``ratios`` under a Gaussian of standard deviation ``width`` lines, cut off at three."""
    reach = int(np.ceil(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, mode="valid")


def threshold(values: np.ndarray) -> float:
    """Midway between the means of two clusters of ``values``."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above):
            break
        means = float(below.mean()), float(above.mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The page's content, one block a line; empty without any."""
    if not html:
        return ""
    lines = page_lines(html)
    if not lines:
        return ""
    density = smoothed(np.array([len(line.text) / max(1, line.tags) for line in lines]))
    cut = threshold(density)
    regions: dict[int, list[int]] = {}
    for place, line in enumerate(lines):
        regions.setdefault(line.region, []).append(place)
    articles = {r: p for r, p in regions.items() if lines[p[0]].in_article}
    candidates = articles or regions
    best = max(candidates.values(), key=lambda places: (density[places].max(), -places[0]))
    kept: list[int] = []
    for places in candidates.values():
        if places is best or density[places].max() >= cut:
            kept += places
    return "\n".join(lines[p].text for p in sorted(kept))


def extract_text(
    pages: DataFrame, html_column: str = "html", text_column: str = "text", length_column: str = "n_chars"
) -> DataFrame:
    """``pages`` with the main text and its code points in the place of the HTML.

    Character references are decoded, white space inside a block is one space, blocks
    are joined by a line feed in page order. NULL and empty pages, and pages without
    text, give an empty text. All other columns stay, but for ones named like the two
    new columns. Repeated rows are read each; pages are read whole. An empty table
    gives no rows.
    """
    others = [c for c in pages.columns if c not in (html_column, text_column, length_column)]
    fields = [pages.schema[c] for c in others]
    schema = T.StructType(fields + [T.StructField(text_column, T.StringType()), T.StructField(length_column, T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(len(others))]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *columns], names=names)

    return pages.select(*others, html_column).mapInArrow(run, schema)
