"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: What a character counts inside articles and mains, and outside them, on pages that have any.
INSIDE, OUTSIDE = 8, 0.25
#: Lines of this length are text whatever they end with; shorter ones if they are sentences, paragraphs or headings.
LINE_LENGTH = 40
SENTENCE_ENDS = frozenset(".!?…:;,\"'”’»)。！？：；）」』।؟")
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: Short notes on rights are no text.
NOTE_LENGTH = 300
_RIGHTS = re.compile(r"©|\(c\)\s|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)

_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|select|button|title|canvas|audio|video"
# attributes as a browser reads them: quotes count after = alone, and a page may end within a tag; each part is passed once
BODY = r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)"
_PIECE = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({_RAW})(?![^\s/>]){BODY}|<(/?)([a-zA-Z][^\s/>]*+){BODY}", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for t in _RAW.split("|")}

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDES = frozenset("nav header footer aside form menu dialog head fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
ASIDE_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
        "footer gdpr header masthead menu modal nav navbar navigation newsletter notice outbrain pagination pager popup promo promoted promotion "
        "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser toolbar widget"
    ).split()
)
#: Words that may stand beside these in one name, as in comment-list or sidebar-left.
PLACES = frozenset("area bar block box buttons container inner left links list posts right section site top bottom wrap wrapper".split())
#: What readers or others wrote: as long as a main text at times, so length alone doesn't make it one.
TALK = frozenset("comment comments disqus related replies respond".split())
_WORD = re.compile(r"[a-z]+")
_ENDS_ITSELF = frozenset("p li dt dd option tr td th".split())


def _names(attributes: str) -> set[str]:
    """The aside words of those class and id names that consist of nothing else."""
    out: set[str] = set()
    for m in _ATTR.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or "").strip("\"'").lower().split():
                words = set(_WORD.findall(name))
                if words & ASIDE_WORDS and words <= ASIDE_WORDS | PLACES:
                    out |= words & ASIDE_WORDS
    return out


def _aside(tag: str, attributes: str) -> bool:
    """Whether an element stands beside the main text by its tag or role, or is hidden."""
    if tag in ASIDES:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ASIDE_ROLES:
            return True
    return False


class _Named:
    """An element whose class or id says that it stands beside the main text, which the lengths of its blocks decide."""

    def __init__(self, up: _Named | None, begin: int, talk: bool):
        self.up, self.begin, self.talk = up, begin, talk
        self.closed = False
        self.article: int | None = None  # the block at which the first article in it opens
        self.firm: _Named | None = None  # the nearest one around it that was closed
        self.holds = 0.0
        self.kept = True

    def at(self, block: int) -> _Named | None:
        """The named element around a block: one that was never closed ends where an article opens, and with it all
        around it that were never closed."""
        return self if self.closed or self.article is None or block < self.article else self.firm


class _Article:
    """An article or main element: the one around it, the outermost one, and whether one in it holds text."""

    def __init__(self, up: _Article | None):
        self.up = up
        self.top: _Article = up.top if up else self
        self.wraps = False
        self.held = 0


class Block(NamedTuple):
    """A line of the page: its text, the characters outside links, the article around it, the tag it stands in."""

    text: str
    free: int
    article: _Article | None
    tag: str


def _without_asides(blocks: list[Block], around: list[_Named | None], named: list[_Named]) -> list[Block]:
    """The blocks but those in named elements. One that holds more than half of what its surroundings hold, as weighed,
    stays; one of comments or the like only if the rest is too short for a surge."""
    page = _Named(None, 0, False)
    page.closed = True
    for x in named:  # from the outer to the inner ones
        x.firm = x.up if x.up and x.up.closed else x.up.firm if x.up else None
    for x in named:
        x.up = (x.up and x.up.at(x.begin)) or page
    own = [(x and x.at(i)) or page for i, x in enumerate(around)]
    for x, b in zip(own, blocks, strict=True):
        x.holds += b.free * (INSIDE if b.article else OUTSIDE)
    for x in reversed(named):
        x.up.holds += x.holds
    for x in named:
        rest = x.up.holds - x.holds
        x.kept = x.up.kept and x.holds > rest and (not x.talk or rest < SURGE * INSIDE)
    return [b for b, x in zip(blocks, own, strict=True) if x.kept]


def line_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order: text outside asides, references decoded and white space squeezed. Linear in
    the page's length, however its tags nest."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[bool] = []
    links = 0
    aside: list[str] = []  # open elements from the aside on, and how many there are of each
    beside: Counter[str] = Counter()
    article: _Article | None = None
    line = ""
    opened: list[tuple[str, _Named | None]] = []
    depth: Counter[str] = Counter()
    names: list[_Named] = []  # the named ones of those
    named: list[_Named] = []
    around: list[_Named | None] = []

    def step_aside(tag: str) -> None:
        aside.append(tag)
        beside[tag] += 1

    def enter(tag: str, words: set[str]) -> None:
        x = None
        if words:
            x = _Named(names[-1] if names else None, len(out), not TALK.isdisjoint(words))
            names.append(x)
            named.append(x)
        opened.append((tag, x))
        depth[tag] += 1

    def leave(tag: str) -> None:
        while depth[tag]:
            t, x = opened.pop()
            depth[t] -= 1
            if x:
                names.pop()
                x.closed = t == tag or t in _ENDS_ITSELF
            if t == tag:
                break

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                free = " ".join("".join(p for p, a in zip(parts, linked, strict=True) if not a).split())
                out.append(Block(text, len(free), article, line))
                around.append(names[-1] if names else None)
            parts.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = _PIECE.search(page, at)
        raw = page[at : m.start() if m else size]
        if raw and not aside:
            parts.append(entities.unescape(raw))
            linked.append(links > 0)
        if not m:
            break
        at = m.end()
        if m[1]:
            if m[2].endswith("/") and m[1].lower() in ("svg", "math"):
                continue
            close = CLOSE[m[1].lower()].search(page, at)
            # one that never ends holds the rest, as in a browser
            at = close.end() if close else size
            if not aside and m[1].lower() in ("title", "textarea", "select", "iframe", "object", "audio", "video"):
                end_block()
            continue
        tag = (m[4] or "").lower()
        if not tag:
            continue
        closing = bool(m[3])
        if aside:
            if closing and beside[tag]:
                while (last := aside.pop()) != tag:
                    beside[last] -= 1
                beside[tag] -= 1
            elif closing and tag in ("body", "html") or not closing and tag in ("article", "main", "body"):
                aside.clear()  # one that was never closed
                beside.clear()
            elif not closing and tag == aside[0] or not closing and tag not in VOID and tag not in INLINE and tag not in _ENDS_ITSELF:
                step_aside(tag)
            if closing or tag not in ("article", "main"):
                continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag in INLINE:
            if closing:
                if depth[tag]:
                    if opened[-1][1]:
                        end_block()
                    leave(tag)
            elif tag not in VOID:
                words = _names(m[5])
                if _aside(tag, m[5]):
                    end_block()
                    step_aside(tag)
                elif words or depth[tag]:
                    if words:
                        end_block()
                    enter(tag, words)
            continue
        end_block()
        links = 0
        line = line if tag in VOID else "" if closing else tag
        if closing:
            leave(tag)
            if tag in ("article", "main") and article:
                article = article.up
            continue
        if opened and (opened[-1][0] == "p" or opened[-1][0] == tag and tag in _ENDS_ITSELF):
            leave(opened[-1][0])
        if tag in ("article", "main"):
            for x in reversed(names):
                if x.article is not None:
                    break
                x.article = len(out)
            article = _Article(article)
            enter(tag, _names(m[5]) & {"comment", "comments", "related", "teaser", "promo", "sponsored"})
        elif tag not in VOID:
            if _aside(tag, m[5]):
                step_aside(tag)
            else:
                enter(tag, _names(m[5]) if tag not in ("html", "body") else set())
    end_block()
    return _without_asides(out, around, named) if named else out


def weighed(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of each block, whether it is inside, whether it may be kept).

    A block weighs what it holds outside links; nothing if that is less than half of it, if it is a note on rights, or if
    it is short and no sentence and no paragraph or heading: names of menus and buttons. Those last may be kept between
    others. Characters in an article or main count INSIDE each, links too unless it wraps further ones, and all else
    OUTSIDE; where what is outside still weighs more, all count alike and none is inside."""
    length = np.array([len(b.text) for b in blocks], float)
    free = np.array([b.free for b in blocks], float)
    inside = np.array([b.article is not None for b in blocks])
    fit = (free * 2 >= length) & ~np.array([len(b.text) < NOTE_LENGTH and bool(_RIGHTS.search(b.text)) for b in blocks])
    spoken = (length >= LINE_LENGTH) | np.array([b.tag in TEXT_TAGS or b.text[-1] in SENTENCE_ENDS for b in blocks])
    plain = np.where(fit & spoken, free, 0.0)
    for b in blocks:
        if b.article:
            b.article.held += len(b.text)
            up = b.article.up
            while up and not up.wraps:
                up.wraps, up = True, up.up
    # links are part of an article's sentences, but lists of them stand beside the articles of a main
    most: dict[int, _Article] = {}
    for b in blocks:
        if b.article and ((x := most.get(id(b.article.top))) is None or b.article.held > x.held):
            most[id(b.article.top)] = b.article
    whole = np.array([bool(b.article) and (not b.article.wraps or b.article is most[id(b.article.top)]) for b in blocks])
    full = np.where(whole, length, free)
    if inside.any() and full[inside].sum() * INSIDE >= plain[~inside].sum() * OUTSIDE:
        return np.where(inside, full * INSIDE, plain * OUTSIDE), inside, np.where(inside, full > 0, fit)
    return plain, np.zeros(len(blocks), bool), fit


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between the surge and dive points of the blocks' length distribution.

    The weights of each `window` neighbouring blocks are summed up, inside articles and outside them. Text surges where a
    sum reaches `surge`, or half of the page's largest sum if that is less, and dives where the sums fall below: a
    stretch holds the windows in a row that reach it, from its first to its last block with weight. What it spans is
    kept but for blocks of links and notes on rights.
    """
    blocks = line_blocks(page) if page else []
    if not blocks:
        return ""
    weight, inside, fit = weighed(blocks)
    keep = np.zeros(len(blocks), bool)
    windows = [(side, np.convolve(weight * side, np.ones(window))[window - 1 :]) for side in (inside, ~inside)]
    least = min(surge, max(sums.max() for _, sums in windows) / 2)
    for side, sums in windows if least > 0 else ():
        covered = side & (np.convolve(sums >= least, np.ones(window))[: len(blocks)] > 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
        for start, dive in zip(edges[::2], edges[1::2], strict=True):
            heavy = start + np.flatnonzero(weight[start:dive])
            if len(heavy):
                keep[heavy[0] : heavy[-1] + 1] = fit[heavy[0] : heavy[-1] + 1]
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(page_id, url, text) of each page: its main text, blocks joined by a line feed; empty if there is none.

    Null and empty pages have none. Scripts, styles, comments, hidden and aside elements never count; unclosed tags end
    where a browser would end them or at the next article. Repeated rows and null ids and urls keep their rows. An empty
    table gives no rows; other columns are ignored. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(t.as_py(), window, surge) for t in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
