"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements. Every node gets features of its tag, attribute
tokens, depth, subtree density and siblings; boosted trees turn them into log-odds of being main
text. Decoding is hierarchical: among all choices in which a dropped node takes its subtree along,
the one with the largest sum of log-odds wins, so an ancestor and its descendant never contradict.

The trees are trained on a bounded sample of pages. Their labels come from semantic markup where a
page has it (article, main, nav, aside, ...) and from attribute tokens. Every page is also trained
on with a planted block of comments, notices or the like; in part of the sample the features of
semantic tags are hidden, so that attributes, density, depth and siblings carry pages without them.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.boosting import BoostedTrees, fit_trees
from replyloom.llm.common import byte_slices, field, frame
from replyloom.session import ship_package

#: Pages that the trees are trained on at most, chosen by a hash of their id.
TRAIN_PAGES = 400
#: Bytes of a page beyond which it is not trained on; every page is extracted whole.
TRAIN_BYTES = 200_000

#: Elements of HTML by their role.
BLOCKS = frozenset(
    "html body div section article main header footer nav aside form ul ol li table caption thead "
    "tbody tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd figure figcaption address "
    "fieldset legend details summary center dialog menu hgroup search button select option label "
    "noscript iframe object video audio canvas svg hr template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
OUTSIDE = frozenset("nav header footer aside form menu button select option label noscript iframe "
                    "object video audio canvas svg dialog fieldset search template".split())
INSIDE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p pre blockquote li td th dt dd figcaption".split()) | HEADINGS
#: Attribute tokens that mark what is not main text, and what is.
AWAY = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer form gdpr header hidden login masthead menu modal nav "
    "navbar navigation newsletter notice notification overlay pager pagination popup promo "
    "promoted recommended related replies reply search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags toolbar widget".split())
TOWARDS = frozenset("article body content entry main post story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?",
    re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An element that opens here ends open elements of these kinds, up to one of the fences.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "option": ({"option"}, {"select"})}


class Page:
    """Block nodes of a page in document order, and its runs of text."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.tokens: list[frozenset[str]] = [frozenset()]
        self.runs: list[tuple[int, list[str]]] = []
        self.linked: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, links, at, fresh = [0], 0, 0, True
        low = None
        while at < len(source):
            found = _TAG.search(source, at)
            piece = source[at:found.start()] if found else source[at:]
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                if fresh or not self.runs:
                    self.runs.append((stack[-1], []))
                    fresh = False
                self.runs[-1][1].append(piece)
                if links:
                    self.linked[stack[-1]] += len(piece)
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCKS:
                    fresh = True
                    if any(self.tag[n] == name for n in stack[1:]):
                        while len(stack) > 1 and self.tag[stack.pop()] != name:
                            pass
                continue
            if name == "br":
                if not fresh and self.runs:
                    self.runs[-1][1].append(" ")
                continue
            if name in RAW:
                low = low if low is not None else source.lower()
                end = low.find("</" + name, at)
                close = source.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(source)
                continue
            if name == "a":
                links += 1
            if name in BLOCKS:
                fresh = True
                if name in ("html", "body"):
                    self.tokens[0] |= self._tokens(found[3])
                    continue
                self._close_implied(stack, name)
                if name not in VOID:
                    self._open(stack, name, found[3])

    def _close_implied(self, stack: list[int], name: str) -> None:
        if name not in ("button", "label", "option", "select") and self.tag[stack[-1]] == "p":
            stack.pop()
        kinds, fences = _ENDS.get(name, (set(), set()))
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in fences:
                break
            if tag in kinds:
                del stack[i:]

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.depth.append(len(stack))
        self.tokens.append(self._tokens(attributes))
        self.linked.append(0)
        stack.append(len(self.tag) - 1)

    @staticmethod
    def _tokens(attributes: str) -> frozenset[str]:
        if "=" not in attributes:
            return frozenset()
        values = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
        return frozenset(t.lower() for t in _TOKEN.findall(values))

    def blocks(self) -> list[tuple[int, str]]:
        """Node and text of every run that has some, white space squeezed."""
        joined = ((n, " ".join("".join(parts).split())) for n, parts in self.runs)
        return [(n, t) for n, t in joined if t]


FEATURES = (
    "outside", "outside_above", "inside", "inside_above", "away", "away_above", "towards",
    "heading", "paragraph", "item", "cell", "container", "depth", "own_chars", "subtree_chars",
    "subtree_nodes", "density", "link_share", "marks_share", "children", "siblings",
    "same_siblings", "sibling_chars", "place", "page_share", "start_share", "parent_links")
_MARKUP = tuple(range(4))


def node_features(page: Page, blocks: list[tuple[int, str]]) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    own, marks, start = [0] * n, [0] * n, [-1] * n
    total = 0
    for node, text in blocks:
        own[node] += len(text)
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        if start[node] < 0:
            start[node] = total
        total += len(text)
    chars, links, dots, nodes = own[:], page.linked[:], marks[:], [1] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        dots[p] += dots[i]
        nodes[p] += nodes[i]
        kids[p].append(i)
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    rows = []
    above: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    place = [0] * n
    for k in kids:
        k.reverse()
        for j, i in enumerate(k):
            place[i] = j
    log = math.log1p
    kinds = [Counter(page.tag[i] for i in k) for k in kids]
    for i in range(n):
        tag, p = page.tag[i], page.parent[i]
        outside, inside = tag in OUTSIDE, tag in INSIDE
        away, towards = len(page.tokens[i] & AWAY), len(page.tokens[i] & TOWARDS)
        up = above[p] if p >= 0 else (0, 0, 0)
        above[i] = (up[0] or outside, up[1] or inside, up[2] + away)
        size = len(kids[p]) if p >= 0 else 1
        same = kinds[p][tag] if p >= 0 else 1
        rows.append((
            outside, up[0], inside, up[1], away, up[2], towards, tag in HEADINGS, tag == "p",
            tag == "li", tag in ("td", "th"), tag in ("div", "section"), page.depth[i],
            log(own[i]), log(chars[i]), log(nodes[i]), chars[i] / nodes[i],
            min(1.0, links[i] / chars[i]) if chars[i] else 0.0,
            dots[i] / chars[i] if chars[i] else 0.0, log(len(kids[i])), log(size), same / size,
            log((chars[p] - own[p]) / size) if p >= 0 else log(chars[i]), place[i] / size,
            chars[i] / total if total else 0.0, start[i] / total if total and start[i] > 0 else 0.0,
            min(1.0, links[p] / chars[p]) if p >= 0 and chars[p] else 0.0))
    return np.array(rows, np.float32)


def markup_labels(page: Page) -> np.ndarray:
    """1 main text, 0 not, -1 unknown, by the page's own semantic markup."""
    n = len(page.tag)
    known = any(t in INSIDE for t in page.tag)
    away, inside = [False] * n, [False] * n
    labels = np.full(n, -1, np.int8)
    for i in range(1, n):
        p, tag = page.parent[i], page.tag[i]
        away[i] = away[p] or tag in OUTSIDE or bool(page.tokens[i] & AWAY)
        inside[i] = inside[p] or tag in INSIDE
        if away[i]:
            labels[i] = 0
        elif inside[i]:
            labels[i] = 1
        elif known:
            labels[i] = -1 if any(page.parent[j] == i and page.tag[j] in INSIDE
                                  for j in range(i + 1, n)) else 0
        elif tag in FLOW:
            labels[i] = 1
    return labels


#: Kinds of blocks that are put into copies of training pages, as few tables hold them all.
PLANTED = ("comments", "sidebar", "cookie-notice", "related", "newsletter", "share", "promo")


def with_planted_block(source: str, page: Page, turn: int) -> str:
    """A copy of a page with one more block of its own prose, marked as not main text, at the end
    of the article or, if there is none, of the body."""
    longest = max((t for _, t in page.blocks()), key=len, default="")[:400]
    block = (f'<div class="{PLANTED[turn % len(PLANTED)]}"><p>{html.escape(longest)}</p>'
             f"<p>{html.escape(longest[:80])}</p></div>")
    for mark in ("</article>", "</main>", "</body>"):
        head, found, tail = source.rpartition(mark)
        if found:
            return head + block + found + tail
    return source + block


def decode(page: Page, gain: np.ndarray) -> list[bool]:
    """Which nodes stay: the best choice in which no kept node is below a dropped one."""
    n = len(page.tag)
    keep, drop = gain.astype(float).tolist(), (-gain).astype(float).tolist()
    keep[0] = drop[0] = 0.0
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    stays = [True] * n
    for i in range(1, n):
        stays[i] = stays[page.parent[i]] and keep[i] >= drop[i]
    return stays


def extract(sources: list[str], trees: BoostedTrees) -> list[str]:
    """Main texts of some pages; their nodes are scored together."""
    pages = [Page(s) for s in sources]
    blocks = [p.blocks() for p in pages]
    features = [node_features(p, b) for p, b in zip(pages, blocks)]
    gains = trees.margin(np.concatenate(features)) if features else np.empty(0)
    out, at = [], 0
    for page, own, x in zip(pages, blocks, features):
        stays = decode(page, gains[at:at + len(x)])
        at += len(x)
        out.append("\n\n".join(t for n, t in own if stays[n]))
    return out


def train_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                    max_pages: int = TRAIN_PAGES, max_bytes: int = TRAIN_BYTES) -> BoostedTrees:
    """Fit the trees on at most ``max_pages`` pages, chosen among those of ``max_bytes`` or less;
    without such pages they drop nothing."""
    ship_package(pages.sparkSession)
    small = pages.filter(F.coalesce(F.octet_length(html_col), F.lit(0)) <= max_bytes)
    chosen = (small.select(id_col).filter(F.col(id_col).isNotNull())
              .orderBy(F.xxhash64(id_col), id_col).limit(max_pages))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "html"):
            ids = part.column(part.schema.get_field_index("id")).to_pylist()
            for own, text in zip(ids, texts):
                source = text.decode("utf-8", "replace")
                page = Page(source)
                planted = Page(with_planted_block(source, page, zlib.crc32(text)))
                rows = [(node_features(p, p.blocks()), markup_labels(p)) for p in (page, planted)]
                x, y = (np.concatenate(part) for part in zip(*rows))
                x, y = x[y >= 0], y[y >= 0]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([own], pa.int64()),
                    "x": pa.array([x.ravel().tolist()], pa.list_(pa.float32())),
                    "y": pa.array([y.tolist()], pa.list_(pa.int8()))})

    # At most max_pages ids; a page repeated under one id is trained on once.
    sample = (small.select(F.col(id_col), F.col(html_col).alias("html"))
              .join(F.broadcast(chosen.distinct()), id_col)
              .select(F.col(id_col).cast("long").alias("id"), "html")
              .mapInArrow(measured, "id long, x array<float>, y array<byte>")
              .orderBy("id", F.xxhash64("x")).limit(max_pages).collect())
    xs, ys = [], []
    for k, row in enumerate(sample):
        x = np.array(row["x"], np.float32).reshape(-1, len(FEATURES))
        y = np.array(row["y"], np.float64)
        xs.append(x)
        ys.append(y)
        if k % 3 == 0:  # the same page without its markup
            hidden = x.copy()
            hidden[:, _MARKUP] = 0
            xs.append(hidden)
            ys.append(y)
    if not xs or not sum(map(len, ys)):
        return BoostedTrees.constant(1.0)
    return fit_trees(np.concatenate(xs), np.concatenate(ys))


def extract_main_text(pages: DataFrame, trees: BoostedTrees, id_col: str = "page_id",
                      url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, the URL, ``text`` and ``n_chars``.

    Whole pages, one narrow pass. A null page has an empty text, and so has one without main
    text. Repeated rows come back repeated; other columns are not read.
    """
    ship_package(pages.sparkSession)

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in byte_slices(batches, "html"):
            texts = extract([s.decode("utf-8", "replace") for s in sources], trees)
            yield frame(part, [id_col, url_col], {
                "text": pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(id_col, url_col, F.col(html_col).alias("html")).mapInArrow(
        extracted, f"{field(pages, id_col)}, {field(pages, url_col)}, text string, n_chars long")
