"""Main text of web pages from flat text blocks (operator 8).

A page is read as a run of flat text blocks, cut at block-level tags. Each block has its word count and link density and
those of the blocks beside it, what the tags around it say, and is told apart as content or not by a decision tree. The
tree is grown at import from the small labelled table TABLE below; growing takes a few milliseconds and is deterministic.
Pages are judged one by one in one pass without a shuffle.

Defined results: null, empty and tag-only pages give an empty text; pages of any length and depth are read whole and
without recursion; unclosed tags, comments and quotes end where the page does; repeated rows give repeated results; null
ids and urls stay null; an empty table gives no rows; other columns pass by unread.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements: those that hold no text of the page, those that part blocks, and those that say what they hold. A head is none of
# them: what it may hold is silent, and other text ends it.
SILENT = "script style noscript template svg math iframe object canvas audio video title textarea select button".split()
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = BLOCK - set("br hr p dd dt li option tr td th h1 h2 h3 h4 h5 h6".split()) | {"span"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Words of class, id and role names that mark what is not the article; those of WRAPPING may also stand on what is around it.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "popup modal newsletter subscribe subscription comment comments commentlist reply replies respond disqus "
    "recommended recommendations trending nav navbar navigation breadcrumb breadcrumbs footer "
    "pagination pager complementary contentinfo".split()
)
WRAPPING = set("notice notices alert overlay signup login side aside widget widgets menu header masthead topbar social search form toolbar tags legal copyright disclaimer hidden skip".split())
TAG = re.compile(
    rf"<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<=/)>|<({'|'.join(SILENT)})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</\1(?=[\s/>])[^>]*>|.*)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(?:/?[a-z]|[!?/])[^>]*(?:>|$)",
    re.I | re.S,
)
#: Those that also name what a whole page has beside its article, and the names that say only that it has it or not.
SOFT = set("sidebar related share sharing".split())
LAYOUT = re.compile(r"(?<![a-z])(?:has|have|no|with|without)[-_]+(?:(?:left|right)[-_]+)?(?:sidebar|related|share|sharing)(?![a-z])")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int  #: 1 inside the article element, 0 if the page has none, -1 outside it
    away: bool  #: inside an element that is not the article's
    heading: bool


def marked(attributes: str) -> tuple[int, bool]:
    """Whether an element's names or state set it apart from the article: 2 for good, 1 unless the article is inside it; and
    whether a name of SOFT does."""
    if not attributes.strip():
        return 0, False
    text = LAYOUT.sub(" ", " ".join(a or b or c for a, b, c in MARK.findall(attributes)).lower())
    names = set(re.split(r"[^a-z]+", text))
    soft = not SOFT.isdisjoint(names)
    if not HINTS.isdisjoint(names) or UNSEEN.search(attributes):
        return 2, soft
    return int(soft or not WRAPPING.isdisjoint(names)), soft


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order.

    An article's level is the number of elements with a name of SOFT around it, counted from the main element. A page's
    articles are those of level 0; without one, those of the least level are not set apart, and all blocks are judged alike."""
    found: list[tuple] = []
    # open holders: name, least level of the articles around, set apart, soft names around, level of the innermost article
    stack: list[tuple[str, float, int, int, int]] = []
    heading = link = False
    inside, least = math.inf, math.inf
    away = soft = level = 0
    pieces: list[str] = []
    linked: list[str] = []
    at = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((text, len(text.split()), len(html.unescape("".join(linked)).split()), inside, away, heading, level))
            pieces, linked = [], []

    for tag in TAG.finditer(page):
        if tag.start() > at:
            pieces.append(page[at : tag.start()])
            if link:
                linked.append(page[at : tag.start()] + " ")
        at = tag.end()
        name = (tag[3] or "").lower()
        if tag[1] or not name:
            continue
        if name == "a":
            link = not tag[2]
        if name in BLOCK:
            flush()
            heading = not tag[2] and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            link = link and name not in HOLDERS
        if name not in HOLDERS or tag[4].endswith("/"):
            continue
        if not tag[2]:
            stack.append((name, inside, away, soft, level))
            apart, softly = marked(tag[4]) if name not in ("html", "body") else (0, False)
            soft += softly
            article = name in ("article", "main") and not apart and away < 2
            if article:
                level = soft = 0 if name == "main" else soft
                inside, least = min(inside, level), min(least, level)
            away = 0 if article else max(away, apart, 2 * (name in AWAY), int(name == "header" and inside == math.inf))
        elif any(n == name for n, *_ in stack):
            while True:
                opened, inside, away, soft, level = stack.pop()
                if opened == name:
                    break
    if at < len(page):
        pieces.append(page[at:])
    flush()
    has_article = least < math.inf
    return [Block(t, w, x, 0 if least or not has_article else 1 if i == 0 else -1, a > 0 or v > least, h) for t, w, x, i, a, h, v in found]


def features(run: list[Block]) -> np.ndarray:
    """Word counts and link densities of each block and its neighbours, its place, whether it is set apart, a heading."""
    words = np.array([0, *(b.words for b in run), 0], float)
    density = np.array([0, *(b.linked / b.words for b in run), 0], float)
    own = np.array([[b.place, b.away, b.heading] for b in run], float).reshape(-1, 3)
    return np.column_stack([words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:], own])


# The labelled table: words before, here, after; link density before, here, after; place; set apart; heading; content.
TABLE = np.array(
    [
        # pages with an article element: inside it
        *[(a, b, c, 0, d, 0, 1, 0, h, 1) for a, b, c, d, h in [(9, 6, 60, 0, 1), (0, 3, 12, 0, 1), (6, 60, 48, 0, 0), (60, 2, 80, 0, 0), (40, 1, 0, 0, 0), (5, 14, 2, 0.3, 0), (80, 45, 30, 0.1, 0), (3, 200, 4, 0, 0), (30, 7, 25, 0, 1), (12, 1, 9, 0, 0), (50, 10, 40, 0.6, 0)]],
        *[(a, b, c, 1, 0, 0, 1, 0, 0, 1) for a, b, c in [(2, 30, 40), (6, 4, 50), (3, 90, 2)]],
        *[(a, b, c, 0, 0, e, 1, 0, 0, 1) for a, b, c, e in [(40, 30, 2, 1), (60, 4, 3, 0.6), (12, 80, 1, 1), (5, 2, 1, 1)]],
        *[(40, 6, 30, 0, 1, 0, 1, 0, 0, 1), (2, 3, 0, 0, 1, 0, 1, 0, 0, 1)],
        *[(a, b, c, d, d, e, 1, 1, h, 0) for a, b, c, d, e, h in [(50, 9, 40, 0, 0, 0), (20, 60, 5, 0, 0, 0), (10, 2, 2, 1, 1, 0), (30, 4, 9, 0, 0, 1), (2, 35, 12, 0.1, 0, 0), (8, 1, 1, 0.5, 1, 0)]],
        # the same pages: outside it
        *[(a, b, c, d, d, e, -1, w, h, 0) for a, b, c, d, e, w, h in [(0, 1, 1, 1, 1, 1, 0), (1, 2, 1, 1, 1, 0, 0), (1, 9, 5, 0, 0, 1, 0), (6, 25, 4, 0, 0, 0, 0), (80, 2, 0, 0, 0, 1, 0), (60, 3, 4, 0, 0, 0, 0), (3, 70, 20, 0, 0, 1, 0), (4, 5, 30, 0, 0, 0, 1), (30, 110, 0, 0, 0, 0, 0), (2, 1, 1, 0.9, 1, 0, 0)]],
        # pages without one
        *[(a, b, c, 0, d, 0, 0, 0, h, 1) for a, b, c, d, h in [(4, 60, 50, 0, 0), (60, 45, 3, 0.05, 0), (5, 30, 80, 0, 0), (80, 12, 60, 0, 0), (9, 7, 70, 0, 1), (3, 24, 12, 0.1, 0), (50, 9, 40, 0, 0), (40, 5, 55, 0, 1), (70, 20, 0, 0, 0)]],
        *[(a, b, c, 0, 0, e, 0, 0, 0, 1) for a, b, c, e in [(60, 40, 2, 1), (50, 25, 3, 0.8), (70, 90, 1, 1), (40, 15, 6, 0.5)]],
        *[(a, b, c, d, 0, 0, 0, 0, 0, 1) for a, b, c, d in [(2, 40, 30, 1), (3, 25, 60, 0.8), (1, 70, 20, 1)]],
        *[(a, b, c, 0, 1, e, 0, 0, 0, 0) for a, b, c, e in [(0, 1, 1, 1), (40, 2, 2, 1), (0, 3, 50, 0), (20, 6, 30, 0), (30, 8, 0, 0)]],
        *[(a, b, c, d, d, e, 0, w, 0, 0) for a, b, c, d, e, w in [(1, 1, 1, 1, 1, 0), (2, 3, 2, 1, 1, 0), (1, 12, 14, 0.8, 0.9, 0), (70, 4, 0, 0, 0, 1), (2, 40, 8, 0, 0, 1), (30, 9, 50, 0, 0, 1), (0, 2, 1, 0, 0, 0), (3, 3, 2, 0, 0, 0), (50, 20, 3, 0.7, 0.5, 0), (6, 4, 0, 0, 0, 1), (0, 90, 60, 0, 0, 1)]],
    ],
    float,
)


class Tree:
    """A decision tree grown by the Gini index until its leaves are pure or LEAST rows are left."""

    LEAST = 2

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.nodes: list[tuple[int, float, int, int]] = []
        self._grow(rows, labels)

    def _grow(self, rows: np.ndarray, labels: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, float(labels.mean() >= 0.5), 0, 0))
        best = None
        if len(set(labels.tolist())) > 1 and len(labels) >= self.LEAST:
            for f in range(rows.shape[1]):
                values = np.unique(rows[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = rows[:, f] <= cut
                    p, q, n = labels[left].mean(), labels[~left].mean(), left.mean()
                    impurity = n * p * (1 - p) + (1 - n) * q * (1 - q)
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, f, float(cut), left
        if best:
            _, f, cut, left = best
            self.nodes[me] = (f, cut, self._grow(rows[left], labels[left]), self._grow(rows[~left], labels[~left]))
        return me

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        work = [(0, np.arange(len(rows)))]
        while work:
            node, at = work.pop()
            f, cut, low, high = self.nodes[node]
            if f < 0:
                out[at] = cut > 0
            elif len(at):
                left = rows[at, f] <= cut
                work += [(low, at[left]), (high, at[~left])]
        return out


TREE = Tree(TABLE[:, :-1], TABLE[:, -1])


def main_text(pages: list[str]) -> list[str]:
    """The main text of every page; the tree judges all their blocks at once."""
    runs = [blocks(p) for p in pages]
    rows = np.concatenate([features(r) for r in runs]) if runs else np.zeros((0, 9))
    verdicts = iter(TREE(rows).tolist())
    return [" ".join([b.text for b in run if next(verdicts)]) for run in runs]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_text([p or "" for p in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
