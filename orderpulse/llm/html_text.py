"""Main text of web pages by text-to-tag ratio.

The standard-library parser streams events; block elements end a line, and
each line keeps its characters, its number of tags and the elements it lies
in. The ratio of characters to tags per line is smoothed with a Gaussian,
and lines above the deviation of the smoothed ratios form the content
cluster. The region is the smallest container around the whole cluster,
whatever its tag, so short paragraphs and the headline inside it are kept, and
an article beside it that holds none of the cluster is not. Tags and names only
exclude: elements that by their tag, class, id or role are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
never take part. A compound name counts only if all its words are such words
or words of page parts (``related-posts`` does, ``related-work`` does not). A
label or button inside a paragraph is text of that paragraph.

Map-only: each page is handled where it lies, whole, in bounded memory.

Defined results: null or empty html, or a page with nothing left, gives an
empty text. Unclosed and cut-off markup is read as browsers do (an open tag
at the end is no text). Repeated rows are extracted alike; other columns do
not matter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, restore

FEED = 1 << 16
LINK_SHARE = 0.5
SIGMA = 1.0

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody tfoot thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body html blockquote table".split())
REGIONS = frozenset("article main section div".split())
KEPT_OPEN = BREAKS - VOID | {"td", "th"}
#: start tags that end an open paragraph, and elements that a paragraph's end does not reach out of
ENDS_P = KEPT_OPEN - {"body", "head", "html", "title"} | {"hr"}
P_SCOPE = frozenset("table td th caption button object template html".split())
SKIPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe object select button textarea svg canvas "
    "dialog menu audio video map label input fieldset".split())
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names that mark page furniture.
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor "
    "sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav rail footer masthead comment comments "
    "commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "widget toolbar pagination pager login search searchbox copyright disclaimer topbar hidden".split())
# Words of class and id names that only say which part of a page something is.
PART_WORDS = frozenset(
    "area article articles bar block blog body bottom box btn button buttons card cards class col column container content "
    "entry fixed float group head heading holder icon icons id inner item items js layer left link links list main module "
    "outer page panel part pane position post posts primary right row secondary section site slot small stories story sub "
    "text title top unit view web wp wrap wrapper".split())
HEADER_WORDS = frozenset(["header", "siteheader", "pageheader"])
COMMENT_WORDS = frozenset("comment comments commentlist reply replies".split())
#: elements that are text where they stand in a paragraph
INLINE_CONTROLS = frozenset(["label", "button"])
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_OPEN_END = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)$")


class Line:
    __slots__ = ("text", "tags", "links", "path")

    def __init__(self, text: str, tags: int, links: int, path: tuple):
        self.text, self.tags, self.links, self.path = text, tags, links, path


class _Reader(HTMLParser):
    """Collects the lines outside page furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int]] = []  # (tag, skipped, number) from the outside in
        self.count = 0
        self.skipped = 0
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = 0

    def parse_marked_section(self, i, report=1):  # "<![...": a comment, as in browsers
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple((tag, number) for tag, _, number in self.open if tag in CONTAINERS)
            self.lines.append(Line(text, self.tags, self.links, path))
        self.parts = []
        self.tags = self.links = 0

    def _is_skipped(self, tag: str, attrs: list) -> bool:
        if tag in SKIPPED:
            return tag not in INLINE_CONTROLS or not self._in_paragraph()
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        if tag == "header" and not inside:
            return True
        values = {k: v or "" for k, v in attrs}
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
            return True
        if _HIDDEN.search(values.get("style", "")):
            return True
        if tag in ("html", "body", "main"):
            return False
        if values.get("role", "").lower() in SKIPPED_ROLES and not (inside and tag == "header"):
            return True
        names = [{w.lower() for w in _WORD.findall(n)} for k in ("class", "id") for n in values.get(k, "").split()]
        if tag == "article":
            return any(words & COMMENT_WORDS for words in names)
        marks = SKIPPED_WORDS if inside else SKIPPED_WORDS | HEADER_WORDS
        return any(words & marks and words <= marks | PART_WORDS for words in names)

    def _in_paragraph(self) -> bool:
        """Whether text here belongs to an open paragraph."""
        return any(t == "p" for t, _, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.in_link = 1
        if tag in ENDS_P:
            self._end_paragraph()
        if tag in VOID:
            return
        skipped = self._is_skipped(tag, attrs)
        if skipped or tag in KEPT_OPEN:
            if tag in ("li", "option", "dt", "dd", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
                self._close(len(self.open) - 1)
            if skipped and tag not in BREAKS and not self.skipped and tag not in ("script", "style"):
                self.flush()
            self.count += 1
            self.open.append((tag, skipped, self.count))
            self.skipped += skipped

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def _end_paragraph(self) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == "p":
                self._close(at)
            if at >= len(self.open) or self.open[at][0] in P_SCOPE | REGIONS:
                break

    def _close(self, at: int) -> None:
        for _, skipped, _ in self.open[at:]:
            self.skipped -= skipped
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        if tag in ("td", "th"):
            self.parts.append(" ")
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def read_lines(html: str) -> list[Line]:
    reader = _Reader()
    html = html.replace("\x00", "")
    tail = _OPEN_END.search(html, max(0, html.rfind("<")))
    if tail:
        html = html[:tail.start()]
    for begin in range(0, len(html), FEED):
        reader.feed(html[begin:begin + FEED])
    reader.close()
    reader.flush()
    return reader.lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:-radius]
    return np.convolve(ratios, kernel)[radius:-radius] / weight


def ratios_of(lines: list[Line]) -> np.ndarray:
    return np.array([len(x.text) / max(1, x.tags) for x in lines], dtype=float)


def cluster(lines: list[Line]) -> np.ndarray:
    """True for the lines of the content cluster: smoothed text-to-tag ratio
    at or above the deviation of all ratios."""
    ratios = smooth(ratios_of(lines))
    chosen = ratios >= ratios.std()
    return chosen if chosen.any() else np.ones(len(lines), dtype=bool)


def select(lines: list[Line]) -> list[str]:
    """Texts of the lines in the content region."""
    if not lines:
        return []
    chosen = cluster(lines)
    # smoothing takes in short lines beside long ones: of these, lists of links are no content
    text = np.array([x.links <= LINK_SHARE * len(x.text) for x in lines])
    if (chosen & text).any():
        chosen &= text
    content = [x for x, is_content in zip(lines, chosen, strict=True) if is_content]
    # the containers around all content lines, down to the last that may be a region
    around = list(content[0].path)
    for x in content:
        same = 0
        while same < min(len(around), len(x.path)) and around[same] == x.path[same]:
            same += 1
        del around[same:]
    while around and around[-1][0] not in REGIONS:
        around.pop()
    if around:
        return [x.text for x in lines if around[-1] in x.path]
    # only the page itself holds all: its own lines, and from the first to the last of its parts with content
    parts = [next((e for e in x.path if e[0] not in ("html", "body")), None) for x in lines]
    marked = np.array([e is not None and e[0] in ("article", "main") for e in parts])
    if (chosen & marked).any():  # beside these, a part that only smoothing takes in is no content
        ratios = ratios_of(lines)
        dense = chosen & (ratios >= smooth(ratios).std())
        full = {e for e, is_dense in zip(parts, dense, strict=True) if is_dense} | {None}
        chosen &= marked | np.array([e in full for e in parts])
    held = {e for e, is_content in zip(parts, chosen, strict=True) if is_content} - {None}
    whole = {e for e in held if e[0] != "table"}
    at = [n for n, e in enumerate(parts) if chosen[n] or e in held]
    return [x.text for n, (x, e) in enumerate(zip(lines, parts, strict=True))
            if e in whole or chosen[n] or (text[n] and (e is None or at[0] <= n <= at[-1]))]


def main_text(html: str | None) -> str:
    return "\n".join(select(read_lines(html))) if html else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``."""

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    roles = {"html": html_col}
    done = isolate(pages, **roles).withColumn("main", read("html"))
    return restore(done, pages, roles, drop=(html_col,), text=F.col("main"), n_chars=F.char_length("main").cast("long"))
