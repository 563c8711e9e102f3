"""Op 4. Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Lines of a window, and the text outside of links that a window needs for a surge (less if no window has it).
LINES, SURGE = 3, 60
#: On a page with an article or main element, which element is the article: regions below this share of the heaviest are
#: other things (teasers, notices). On other pages every region stays.
SHARE = 0.25
#: On a page with an article or main element, text outside of it weighs this part of its length.
OUTSIDE = 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.I | re.S)
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav header footer aside form menu dialog button".split())
_MAIN = frozenset(("article", "main"))
#: Words of class, id or role that mark an element as no part of the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login social share sharing related recommended comment comments "
    "discussion disqus respond reply replies toolbar pager pagination widget search contentinfo complementary form dialog".split()
)
#: Words that may stand beside a mark: ``site-footer`` is marked, ``with-sidebar`` and ``share-price`` are not.
_NEUTRAL = frozenset("site main page top bottom left right upper lower inner outer box bar block area section container wrapper wrap list item link links holder panel unit slot global primary secondary 1 2 3 4 5".split())
#: Words for reader comments, which mark beside any other word (``post-comments``) but those that state how a page takes them.
_COMMENT, _STATE = frozenset("comment comments commentlist".split()), frozenset("has no with without open closed enabled disabled".split())
#: Words that ``related`` marks together with: ``related-posts`` is marked, ``related-work`` is not.
_RELATED = frozenset("post posts article articles story stories news reading content contents topic topics product products video videos more".split())
#: Elements that end an open paragraph, and the elements whose start ends their like up to the nearest of some others.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_UP_TO = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}
_SCOPE = ("table", "td", "th", "caption", "html")


class _Open:
    """The open elements, with the places of each name, so that every step takes constant time on average."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()

    def start(self, name: str) -> None:
        """End what the start of ``name`` ends by the rules of HTML."""
        if name in _ENDS_P and (p := self.last(("p",))) > self.last(_SCOPE):
            self.cut(p)
        if name in _LIKE and (like := self.last(_LIKE[name])) > self.last(_UP_TO[name]):
            self.cut(like)

    def push(self, name: str) -> None:
        self.at[name].append(len(self.names))
        self.names.append(name)

    def end(self, name: str) -> None:
        at = self.last((name,))
        if at >= 0 and (name in _SCOPE or name == "tr" or at > self.last(_SCOPE)) and not (name in _INLINE and any(n not in _INLINE for n in self.names[-1:])):
            self.cut(at)


def _aside(name: str, attributes: str, inside: bool) -> bool:
    """Whether the element is no part of an article."""
    if name in _ASIDE and not (name == "header" and inside) or attributes and _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return True
    if name in ("html", "body"):
        return False
    marks = set()
    for token in _labels(attributes):
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        if words and all(w in _MARKS or w in _NEUTRAL or w in _RELATED and "related" in words for w in words):
            marks.update(w for w in words if w in _MARKS)
        elif not _STATE.intersection(words):
            marks.update(_COMMENT.intersection(words))
    return bool(marks & (_COMMENT | {"ad", "ads", "advert"}) if name in _MAIN else marks)


def _labels(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {w for m in _LABEL.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}


class Line(NamedTuple):
    """A line without markup; article and form are the numbers of those it is in, or 0; title: it is an h1."""

    text: str
    free: int  # length outside of links
    article: int
    form: int = 0
    title: bool = False


def lines(page: str, wrappers: frozenset[int] | None = frozenset()) -> list[Line]:
    """Lines of a page.

    Elements that are no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments) leave
    an empty line. Forms numbered in ``wrappers`` count as plain elements; with None all do.
    """
    out, parts, opened = [], [], _Open()
    skip, main, number = -1, -1, 0  # depths at which an element that is left out, and an article, begin
    form, inside, forms, title = -1, 0, 0, False  # depth and number of the form around, forms seen
    links = outside = 0

    def end_line() -> None:
        nonlocal outside, title
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, max(0, min(len(text), outside)), number if main >= 0 else 0, inside, title))
        parts.clear()
        outside, title = 0, False

    def add(raw: str) -> None:
        nonlocal outside
        if raw and skip < 0:
            text = html.unescape(raw)
            parts.append(text)
            if not links:
                outside += len(text.strip())

    def shrunk() -> None:
        nonlocal skip, main, form, inside
        if skip >= len(opened.names):
            skip = -1
        if main >= len(opened.names):
            end_line()
            main = -1
        if form >= len(opened.names):
            end_line()
            form, inside = -1, 0

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in _INLINE and skip < 0:
            end_line()
        if name == "a" and skip < 0:
            links = 0 if m[2] else 1
        if m[2]:
            opened.end(name)
            shrunk()
            continue
        opened.start(name)
        shrunk()
        title = skip < 0 and (title or name == "h1")
        forms += name == "form"
        if name in _VOID or m[4].rstrip().endswith("/"):
            continue
        if skip < 0 and name == "form" and (wrappers is None or forms in wrappers):
            form, inside = (form, inside) if inside else (len(opened.names), forms)
        elif skip < 0 and _aside(name, m[4], main >= 0):
            end_line()
            skip, links = len(opened.names), 0
            out.append(Line("", 0, number if main >= 0 else 0))
        elif skip < 0 and main < 0 and (name in _MAIN or "main" in _labels(m[4]) and re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I)):
            main, number = len(opened.names), number + 1
        opened.push(name)
    add(page[at:])
    end_line()
    return out


def wrapping_forms(page: str) -> frozenset[int]:
    """The form that holds more than half of the page's running text (lines of ``SURGE`` and more outside of links).

    Such a form is put around a page, not asked in it. Without running text there is none.
    """
    if "<form" not in page.lower():
        return frozenset()
    held: dict[int, int] = defaultdict(int)
    for line in lines(page, None):
        held[line.form] += line.free if line.free >= SURGE else 0
    return frozenset(n for n, size in held.items() if n and 2 * size > sum(held.values()))


def distribution(found: list[Line]) -> np.ndarray:
    """Weights of the lines, with gaps of empty lines around each article or main element; -1 stands for a gap.

    Outside of such elements a line weighs its text outside of links, on a page that has one ``OUTSIDE`` of it. Inside a
    line weighs all its text and at least a surge, so that short lines, empty ones too, don't end a region.
    """
    marked, out, before = any(x.article for x in found), [], 0
    for line in found:
        if line.article != before:
            out += [-1] * LINES
            before = line.article
        out.append(max(SURGE, len(line.text)) if line.article else int(line.free * OUTSIDE) if marked else line.free)
    return np.array(out, np.int64)


def regions(weight: np.ndarray, share: float = 0.0) -> list[tuple[int, int]]:
    """Lines between the surge and dive points of windows: (start, end), those of at least ``share`` of the heaviest."""
    size = np.maximum(weight, 0)
    sums = np.convolve(np.concatenate([size, np.zeros(LINES - 1, np.int64)]), np.ones(LINES, np.int64), "valid")
    least, out, start = min(SURGE, max(1, int(sums.max(initial=0)))), [], None
    for i, total in enumerate(sums.tolist()):
        if start is None and total >= least and size[i]:  # surge
            start = i
        elif start is not None and total == 0:  # dive
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(size)))
    heavy = [int(size[a:b].sum()) for a, b in out]
    return [r for r, w in zip(out, heavy) if w >= share * max(heavy)]


def headlines(found: list[Line]) -> dict[int, int]:
    """Of articles without an h1 the line of the last h1 before them that is no link and not in an article: article to line."""
    titled, out, last = {x.article for x in found if x.title}, {}, None
    for i, line in enumerate(found):
        if line.title and not line.article and line.free:
            last = i
        elif line.article and last is not None:
            if line.article not in titled:
                out[line.article] = last
            last = None
    return out


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of the lines' lengths, blocks joined by one space.

    On every page the windows decide; article and main elements only change what lines weigh. So a long text
    beside an article element that is a teaser wins, and a short notice beside an article does not. The headline
    beside an article that stays, stays. A form around the page is no aside.
    """
    page = page or ""
    found = lines(page, wrapping_forms(page))
    weight = distribution(found)
    at = np.cumsum(weight >= 0) - 1  # the line of each place that is no gap
    marked = any(x.article for x in found)
    kept = {int(at[k]) for a, b in regions(weight, SHARE if marked else 0.0) for k in range(a, b) if weight[k] >= 0}
    heads = headlines(found)
    kept |= {heads[found[i].article] for i in kept if found[i].article in heads}
    return " ".join(found[i].text for i in sorted(kept) if found[i].text)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null or empty html gives an empty text; other columns are ignored."""
    prepare(pages.sparkSession)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            frame["text"] = [main_text(h if isinstance(h, str) else "") for h in frame.pop("html")]
            yield frame[["page_id", "url", "text"]]

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
