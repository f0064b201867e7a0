"""Operator 7: main text of HTML pages from flat text blocks.

A page is cut into flat text blocks. Each block gets its word count and link
density, those of its neighbours, and where it stands (inside boilerplate or
content elements; class and id hints, of words that mostly name boilerplate
and of words that also name content). A decision tree, trained on the small
labelled table in ``html_labels.py``, keeps or drops it.

Defined cases: a null or empty page gives an empty text; malformed, cut off
or very long markup is read to its end; an unclosed tag counts as markup; an
unclosed script, style or other raw text runs to the end of the page, as HTML
has it, and an unclosed object, video or the like holds nothing; repeated rows
give repeated results; null ids and urls pass through; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements whose content is text that no markup ends but their own end tag.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose content is not shown as text; without an end tag they hold nothing.
_HIDDEN = {"noscript", "template", "object", "svg", "math", "canvas", "audio", "video"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "fieldset"}
_INSIDE = {"article", "main"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = set("area base br col embed hr img input link meta param source track wbr p li dt dd tr td th option".split())
#: Parts of class and id names: those that hardly name anything but boilerplate, those that may, and those of content.
STRONG = set(
    "ad ads advert adverts advertisement adbox adslot banner sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr popup modal overlay sidebar navbar nav navigation menu menus breadcrumb breadcrumbs comment comments commentlist disqus replies respond "
    "footer masthead sharing sharebar related recommended recommendations newsletter subscribe signup pagination pager copyright toolbar adsense taboola outbrain".split()
)
WEAK = set("side form notice notices alert alerts header share social reply login search widget widgets legal skip toc rating ratings foot box popular more links list tags meta register contact".split())
GOOD = set("article articles entry post posts story content main body text prose articlebody".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("outside", "inside", "strong_hint", "weak_hint", "good_hint", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: tuple[int, int, int, int, int, int]

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _State:
    stack: list[tuple[str, int, int, int, int, int]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    anchor: int = 0
    head: int = 0


@lru_cache(maxsize=10_000)
def hints(attributes: str) -> tuple[int, int, int]:
    """Whether class, id, role or label names have a strong, weak, content part."""
    parts = {p.lower() for x in _HINTS.findall(attributes) for p in _PART.findall(x)}
    return int(bool(parts & STRONG)), int(bool(parts & WEAK)), int(bool(parts & GOOD))


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in page order, white space made single, empty ones left out."""
    out: list[Block] = []
    s = _State()

    def place() -> tuple[int, int, int, int, int, int]:
        _, a, b, c, w, d = s.stack[-1] if s.stack else ("", 0, 0, 0, 0, 0)
        return a, b, c, w, d, int(s.head > 0)

    def flush() -> None:
        if s.parts:
            text = " ".join(html.unescape("".join(s.parts)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, len(html.unescape(" ".join(s.linked)).split()), place()))
            s.parts, s.linked = [], []

    def chars(text: str) -> None:
        if text:
            s.parts.append(text)
            if s.anchor:
                s.linked.append(text)

    at, never = 0, set()  # hidden elements that have no end tag from here on
    while (m := _MARKUP.search(page, at)) is not None:
        chars(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW or name in _HIDDEN:
            flush()
            if not closing and not rest.rstrip().endswith("/") and name not in never:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in _RAW:
                    at = len(page)
                else:
                    never.add(name)
        elif name == "a":
            s.anchor = 0 if closing else 1
        elif name == "br":
            chars(" ")
        elif name in _INLINE:
            pass
        else:
            flush()
            s.anchor = 0
            if name in _HEADS:
                s.head = 0 if closing else 1
            if name in _VOID or rest.rstrip().endswith("/"):
                continue
            if closing:
                for k in range(len(s.stack) - 1, -1, -1):
                    if s.stack[k][0] == name:
                        del s.stack[k:]
                        break
            else:
                _, a, b, c, w, d = s.stack[-1] if s.stack else ("", 0, 0, 0, 0, 0)
                strong, weak, good = hints(rest) if rest else (0, 0, 0)
                outside = int(name in _OUTSIDE and not (name == "header" and b))
                if name in _INSIDE:
                    b, strong = int(not (a or strong)), strong & (1 - good)
                s.stack.append((name, a | outside, b, c | strong, w | weak, d | good))
    chars(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    none = Block("", 0, 0, (0, 0, 0, 0, 0, 0))
    rows = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        rows.append((*b.place, b.words, b.links, before.words, before.links, after.words, after.links))
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass
class Tree:
    """A CART node: a leaf with a label, or a test x[feature] <= bound."""

    label: int
    feature: int = -1
    bound: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.label)
        out, under = np.empty(len(x), int), x[:, self.feature] <= self.bound
        out[under], out[~under] = self.low.predict(x[under]), self.high.predict(x[~under])
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> Tree:
    """Gini CART; equal gains go to the earlier feature and the smaller bound, so training is repeatable."""
    node = Tree(int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return node
    best = (1e-12, -1, 0.0)
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    whole = gini(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            under = x[:, f] <= bound
            if min(under.sum(), (~under).sum()) >= least and (gain := whole - gini(y[under]) - gini(y[~under])) > best[0] + 1e-9:
                best = (gain, f, float(bound))
    if best[1] < 0:
        return node
    under = x[:, best[1]] <= best[2]
    return Tree(node.label, best[1], best[2], fit_tree(x[under], y[under], depth - 1, least), fit_tree(x[~under], y[~under], depth - 1, least))


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    from lexora.llm.html_labels import PAGES, composed

    xs, ys = [], []
    for page, labels in [*PAGES, *composed(range(160))]:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {[b.text for b in found]}")
        xs.append(features(found))
        ys.append(labels)
    return fit_tree(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = (tree or default_tree()).predict(features(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
