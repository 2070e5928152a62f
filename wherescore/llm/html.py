"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped and each block of text is a line. Lines of menus, footers, adverts, forms and the like are left out. The
others weigh as much as they have characters outside links; a heading, and a line of an element that marks an article,
weigh more, and other lines of a page with such an element weigh a quarter. Sums over a window of lines surge where an
article begins and dive to nothing where it ends; the lines between such a surge and its dive are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Weight of a window from which it counts as a surge. Headings and lines of a marked article weigh so much more.
SURGE = 80
#: Lines outside a marked article weigh this part of their characters, as do links within it.
PART = 4
#: On pages without a marked article, so many lines of nothing but links are a menu.
MENU = 3

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
DROPPED = frozenset("head nav footer aside form header menu dialog select button textarea datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea noscript template iframe object svg math canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id or role that mark other parts of a page.
_PARTS = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|sidebar|menu|navbar|navigation|nav|"
    "breadcrumb|breadcrumbs|footer|header|masthead|cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|"
    "newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|reply|"
    "replies|disqus|pagination|pager|toolbar|widget|complementary|contentinfo|search"
)
_MARKED = re.compile(rf"(?:^|[\s_-])(?:{_PARTS})(?:$|[\s_-])", re.I)
#: An attribute, or the bracket that ends its tag. Within a value the other kind of quote is plain text; a quote that is never
#: closed, or that does not begin a value, is plain text too.
_ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<double>[^"]*+)"|'(?P<single>[^']*+)'|(?P<bare>[^\s>]*+)))?)"""
)
_KIND = re.compile(r"\b(?:class|id|role|hidden|href)$", re.I)
#: Parts of a page that never hold its article, and that an element like ``<article class="comment">`` may be.
_STRONG = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|comments?|reply|replies|disqus|related|"
    r"recommended)(?:$|[\s_-])",
    re.I,
)
#: Names that say what a page lacks or has around its content, whether it takes comments, or that this is an article's own header.
_ABOUT = re.compile(
    r"(?:^|\s)(?:(?:no|has|with|without)[-_]\S*|(?:comments?|replies|ads?)[-_](?:open|closed|enabled|disabled|free|on|off)"
    r"|(?:article|entry|post|story)[-_]header)(?=\s|$)",
    re.I,
)
#: Words that mean another part of a page, but not of an article.
_OWN = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")
_EMPTY_COMMENT = re.compile("<!--(?:-?>)")
_COMMENT_END = re.compile("--!?>")


@dataclass
class Line:
    text: str
    inside: bool  # of a marked article
    other: bool  # part of a menu, footer, advert ... by the name of an element
    marks: tuple[int, ...]  # the same by class, id or role: numbers of the elements, outermost first
    heading: bool
    linked: int  # characters in links


class State(NamedTuple):
    inside: bool = False
    other: bool = False
    marks: tuple[int, ...] = ()
    heading: bool = False
    link: bool = False


def _attributes(page: str, at: int) -> tuple[int, dict[str, str]]:
    """Place after the tag whose attributes begin at ``at``, and its attributes that tell the kind of part."""
    values: dict[str, str] = {}
    while found := _ATTRIBUTE.match(page, at):
        at = found.end()
        if found["end"]:
            return at, values
        if _KIND.search(found["name"]):
            value = next((v for v in found.group("double", "single", "bare") if v is not None), None)
            if value is not None:
                values.setdefault(found["name"].lower(), value)
    return len(page), values


def _comment_end(page: str, begin: int) -> int:
    """Place after the comment that begins there; without an end it goes to the end of the page."""
    short = _EMPTY_COMMENT.match(page, begin)
    end = short or _COMMENT_END.search(page, begin + 4)
    return end.end() if end else len(page)


class Page:
    """Blocks of text in the order of the page, and what the elements marked by class, id or role hold."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.strong: set[int] = set()  # marked elements that never hold an article
        self.articles: set[int] = set()  # marked elements that hold an element for articles
        self.headings: set[int] = set()  # marked elements that hold a heading
        self._state = State()
        self._buffer: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, State]] = []  # name, state outside
        self._opened: Counter[str] = Counter()
        self._marks = 0
        self._read(page)

    def _text(self, text: str) -> None:
        self._buffer.append(text)
        if self._state.link:
            self._linked += len(text)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self._buffer))).strip()
        if text:
            self.lines.append(Line(text, *self._state[:-1], min(self._linked, len(text))))
        self._buffer.clear()
        self._linked = 0

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self._opened[name]:
            outside = next(state for n, state in reversed(self._stack) if n == name)
            if outside[:-1] != self._state[:-1]:
                self._flush()
            self._state = outside
            while (closed := self._stack.pop()[0]) != name:
                self._opened[closed] -= 1
            self._opened[name] -= 1

    def _open(self, name: str, values: dict[str, str]) -> None:
        if name in ("p", "li", "a") and self._stack and self._stack[-1][0] == name:
            self._close(name)
        before = self._state
        inside, other, marks, heading, link = before
        begins = name in ("article", "main") or values.get("role", "").strip().lower() in ("article", "main")
        other |= name in DROPPED and not (name == "header" and inside)
        words = [_ABOUT.sub(" ", v) for k, v in values.items() if k != "href" and not (name in HEADINGS and k == "id")]
        if inside:
            words = [_OWN.sub(" ", w) for w in words]
        strong = any(map(_STRONG.search, words))
        if name not in ("html", "body") and (strong or (not begins and any(map(_MARKED.search, words)))):
            self._marks += 1
            marks = (*marks, self._marks)
            if strong:
                self.strong.add(self._marks)
        if begins and not other and not strong:
            inside = True
            self.articles.update(before.marks)
        if name in HEADINGS:
            heading = True
            self.headings.update(before.marks)
        state = State(inside, other, marks, heading, link or (name == "a" and "href" in values))
        if state[:-1] != before[:-1]:
            self._flush()
        self._stack.append((name, before))
        self._opened[name] += 1
        self._state = state

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            begin = page.find("<", at)
            if begin < 0:
                self._text(page[at:])
                break
            self._text(page[at:begin])
            follow = page[begin + 1 : begin + 2]
            if page.startswith("<!--", begin):
                at = _comment_end(page, begin)
            elif follow in ("!", "?", "/"):
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
                if follow == "/":
                    self._close(page[begin + 2 : at].rstrip(">").strip().lower())
            elif tag := _NAME.match(page, begin + 1):
                name = tag[0].lower()
                at, values = _attributes(page, tag.end())
                if name == "br":
                    self._buffer.append(" ")
                if name in BLOCKS:
                    self._flush()
                if name in RAW:
                    end = re.compile(f"</{name}", re.I).search(page, at)
                    close = page.find(">", end.end()) if end else -1
                    at = close + 1 if close >= 0 else size
                elif name not in VOID:
                    self._open(name, values)
            else:
                self._text("<")
                at = begin + 1
        self._flush()

    def content(self) -> list[Line]:
        """Lines that are not of other parts.

        A class, id or role may also be that of a wrapper around the whole page. So where all marked articles are in such
        elements, or no line is left, the elements that hold an article (or else a heading) mark nothing.
        """
        free: set[int] = set()
        left = [x for x in self.lines if not x.other and not x.marks]
        if not any(x.inside for x in left):
            wrappers = (self.articles or (set() if left else self.headings)) - self.strong
            free = wrappers
        return [x for x in self.lines if not x.other and free.issuperset(x.marks)]


def lines(page: str) -> list[Line]:
    """Blocks of text in the order of the page, without those of other parts."""
    return Page(page).content()


def _weights(found: list[Line]) -> np.ndarray:
    marked = any(x.inside for x in found)
    out = []
    for x in found:
        plain = len(x.text) - x.linked
        weight = plain + (SURGE if x.heading and plain else 0)
        if x.inside:
            weight = plain + x.linked // PART + (SURGE if plain else 0)
        elif marked:
            weight = plain // PART
        out.append(weight)
    weights = np.array(out, np.int64)
    return weights if weights.any() else np.array([len(x.text) for x in found], np.int64)


def _without_menus(found: list[Line]) -> list[Line]:
    if any(x.inside for x in found):
        return found
    kept: list[Line] = []
    for only_links, part in groupby(found, lambda x: x.linked == len(x.text)):
        part = list(part)
        if not only_links or len(part) < MENU:
            kept += part
    return kept


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, joined by line feeds; empty if there is none.

    The borders of a marked article are those of a stretch; no window reaches beyond them. A surge outside a marked article
    must also be a quarter of the page's highest one, so that a marked teaser does not hide the text beside it.
    """
    found = _without_menus(lines(page))
    if not found:
        return ""
    weights = _weights(found)
    inside = np.array([x.inside for x in found])
    bounds = [0, *(np.flatnonzero(inside[1:] != inside[:-1]) + 1), len(found)]
    stretches = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        total = np.concatenate([[0], np.cumsum(weights[a:b])])
        ends = np.minimum(np.arange(b - a) + window, b - a)
        stretches.append((a, b, total[ends] - total[:-1]))  # sum of the lines from each one on
    peak = max(int(sums.max()) for *_, sums in stretches)
    kept: list[str] = []
    for a, b, sums in stretches:
        least = min(surge, peak) if inside[a] or not inside.any() else max(surge, peak / PART)
        at = 0
        while at < b - a:
            if sums[at] < least:
                at += 1
                continue
            end = at
            while end < b - a and sums[end] > 0:  # up to the dive
                end += 1
            heavy = np.flatnonzero(weights[a + at : a + end])
            kept += [x.text for x in found[a + at + heavy[0] : a + at + heavy[-1] + 1]]
            at = end
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text. Null and empty pages, and pages without text, give an empty text.

    Whole pages are read, nothing is cut. Character references are decoded, white space within a block becomes one space.
    Repeated rows keep a row each, an empty table gives no rows; other columns, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
