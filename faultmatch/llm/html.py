"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import per_batch, ready, texts_of

# fixed values: names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Never part of an article, with all that they hold.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label map menu nav"
    " noframes noscript object optgroup option progress script search select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what is not the article.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation navigator newsletter"
    " notice notification notifications pager pagination popup promo promotion recommended related reply replies respond"
    " responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split()
)
#: Of what is left out, blocks that border the article: lines beyond them are not joined to it.
BORDERS = frozenset(("aside", "footer", "header", "menu", "nav"))
BORDER_WORDS = frozenset(
    "banner comment comments commentlist complementary contentinfo discussion disqus footer header masthead menu nav navbar navigation"
    " navigator recommended related replies respond responses sidebar".split()
)
#: A header of one of these is the article's own.
OWNERS = frozenset(("article", "content", "entry", "post", "story"))
#: With one of these words, a class tells about the page's layout.
NEGATIONS = frozenset(("has", "no", "with", "without"))
#: Elements that hold the page; a class of theirs says nothing about what they hold.
HOLDERS = frozenset(("html", "body", "main", "article"))
#: An open element of the first kind ends where one of the second kind begins, unless a third kind lies between.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
        "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("article aside blockquote body button div dl fieldset form header footer li main nav ol section table td th ul".split())

#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.0
#: Share of the selected text that a container must hold.
MAIN_SHARE = 0.9

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Line(NamedTuple):
    text: str
    tags: int  #: since the line before
    element: int  #: innermost open element
    borders: int  #: border blocks that begin before the line
    linked: bool  #: all of its text is in links


class _Lines(HTMLParser):
    """Cuts a page into lines at the borders of block elements, as the events come.

    Every element gets a number and knows its parent.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.name, self.state = [-1], [""], [0]  # state 1: dropped, 2: hinted at
        self.open = [0]
        self.dropped = 0  # open elements that are dropped
        self.text: list[str] = []
        self.tags = self.borders = self.links = 0
        self.plain = False  # text outside links in the line so far
        self.lines: list[_Line] = []

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text = []
            if line:
                self.lines.append(_Line(line, self.tags, self.open[-1], self.borders, not self.plain))
                self.tags, self.plain = 0, False

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in DROPPED:
            return 1
        if tag == "header":
            return 0 if any(self.name[e] in ("article", "main") for e in self.open) else 1
        if tag in HOLDERS:
            return 0
        state = 0
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return 1
            if not value:
                continue
            if key == "role" and value.lower() in DROPPED_ROLES:
                return 1
            if key == "style" and _HIDDEN.search(value):
                return 1
            if key in ("class", "id"):
                words = [w.lower() for w in _WORDS.findall(value)]
                if not NEGATIONS.isdisjoint(words):
                    continue
                if not OWNERS.isdisjoint(words):
                    words = [w for w in words if w != "header"]
                if not HINTS.isdisjoint(words) or not HINTS.isdisjoint(map("".join, zip(words, words[1:], strict=False))):
                    state = 2
        return state

    @staticmethod
    def is_border(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BORDERS:
            return True
        words = (w.lower() for key, value in attrs if value and key in ("class", "id", "role") for w in _WORDS.findall(value))
        return not BORDER_WORDS.isdisjoint(words)

    def close_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            if self.state[element] == 1:
                self.dropped -= 1
                self.tags = 0  # tags of what is dropped count for no line
            self.links -= self.name[element] == "a"
        del self.open[depth:]

    def end_implied(self, tag: str) -> None:
        ends = ENDS.get(tag, ())
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.name[self.open[depth]]
            if name == "p" or name in ends:
                self.close_to(depth)
                if name != "p":
                    return
            elif name in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if tag not in VOID:
                self.end_implied(tag)
        if tag in VOID:
            return
        state = self.judged(tag, attrs)
        self.parent.append(self.open[-1])
        self.name.append(tag)
        self.state.append(state)
        self.open.append(len(self.name) - 1)
        self.dropped += state == 1
        self.links += tag == "a"
        self.borders += state > 0 and self.is_border(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers open the element all the same

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.name[self.open[depth]] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            self.plain = self.plain or not (self.links or data.isspace())

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # a comment without an end reaches to the end of the page
        super().close()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends, the kernel's share inside counts as the whole."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Border between two clusters of values: the midpoint of their means, moved until it stays."""
    low, high = float(values.min()), float(values.max())
    border = (low + high) / 2
    for _ in range(32):
        below, above = values[values < border], values[values >= border]
        if not len(below) or not len(above):
            break
        new = (float(below.mean()) + float(above.mean())) / 2
        if new == border:
            break
        border = new
    return min(border, float(values.std()) or border)


def _joins(line: _Line, edge: _Line, name: list[str]) -> bool:
    """Whether a line beside the region's first or last one belongs to the article too."""
    if line.borders != edge.borders:
        return False
    heading = re.fullmatch("h[1-6]", name[line.element]) is not None
    return heading or not (line.linked or _LEGAL.search(line.text))


def main_text(page: str) -> str:
    """The article of a page, its blocks in page order with one space between; empty if there is none.

    Lines with a high smoothed ratio of text to tags are content.  The region
    is the innermost element that holds nearly all of it, an article or main
    element inside where that holds most.  All lines of the region are
    kept, short ones too, but for elements that are never part of an article.
    Where no element but the body holds the content, the region reaches from
    the first content line to the last.  On a page without an article or main
    element, the lines before and after the region belong to it up to the next
    menu, header, sidebar or the like, a line of links, or a legal line; so
    headings, leads and endings outside the fullest part stay.
    """
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    parent, name, state = parser.parent, parser.name, parser.state
    # what hints mark goes, unless nothing else is there or the only article lies in it
    for dropped in ((1, 2), (1,)):
        out = [False] * len(parent)
        for element in range(1, len(parent)):
            out[element] = out[parent[element]] or state[element] in dropped
        lines = [x for x in parser.lines if not out[x.element]]
        articles = [e for e in range(1, len(parent)) if name[e] in ("article", "main") and not out[e]]
        if lines and (articles or not any(n in ("article", "main") for n in name)):
            break
    if not lines:
        return ""
    ratios = smoothed(np.array([len(line.text) / max(1, line.tags) for line in lines]))
    content = ratios >= threshold(ratios)
    weight = Counter()
    for line, good in zip(lines, content, strict=True):
        weight[line.element] += len(line.text) * int(good)
    for element in range(len(parent) - 1, 0, -1):
        weight[parent[element]] += weight[element]
    region = 0
    for element in range(1, len(parent)):  # numbers grow inwards, so the last that fits is the innermost
        if not out[element] and weight[element] >= MAIN_SHARE * weight[0] and name[element] in SCOPES:
            region = element
    inside = [e for e in articles if 2 * weight[e] > weight[0]]
    around = set()
    at = region
    while at > 0:
        around.add(at)
        at = parent[at]
    wrapped = [e for e in inside if e in around]
    if wrapped:  # the whole article, not its fullest part
        region = wrapped[-1]
    elif inside:
        region = inside[-1]
    within = [False] * len(parent)
    within[region] = True
    for element in range(1, len(parent)):
        within[element] = within[element] or within[parent[element]] if element != region else True
    if articles:
        return " ".join(line.text for line in lines if within[line.element])
    wide = name[region] in ("", "html", "body")
    kept = np.array([within[line.element] for line in lines]) & (content if wide else True)
    first, last = (int(at) for at in np.flatnonzero(kept)[[0, -1]])
    while first and _joins(lines[first - 1], lines[first], name):
        first -= 1
    while last + 1 < len(lines) and _joins(lines[last + 1], lines[last], name):
        last += 1
    return " ".join(line.text for line in lines[first : last + 1])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``, one row a page.

    Null and empty pages, and pages without an article, have the empty text.
    Rows are independent: nulls in the kept columns and repeated rows stay.
    Other columns are left out.
    """
    ready(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(t) if t else "" for t in texts_of(batch.column(len(keep)))]
            return pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

        return step

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return per_batch(rows, make, f"{fields}text string, n_chars long")
