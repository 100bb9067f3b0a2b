"""Main-text extraction: boosted trees over DOM nodes, decoded as a hierarchy.

A page becomes a tree of elements (implied end tags closed, stray ones ignored).
Each element gets features: its tag's kind, token classes of its class, id and role,
the same of its ancestors, depth, text size, link and tag density of its subtree,
punctuation, place in the page, and its share of its parent and rank among its
siblings.  Gradient-boosted trees give each element the probability that its subtree
holds text of the article.  Decoding picks the likeliest labelling in which whatever
is inside a dropped element is dropped as well: from the leaves up, an element is
kept if its own log probability and its children's best sum to more than dropping
the whole subtree.

The model is fitted on the driver from PAGES pages that generate() writes with known
labels, in many layouts; no row of a table is used, so its figures do not depend on one.

The text: character references decoded, white space within a block turned into one
space and trimmed, blocks joined by one space in page order; scripts, styles, forms'
fields, drawings, embedded frames and comments in the markup hold no text, formulas and
noscript do.  Whether an element is shown is not judged.  Defined results: a null or
empty page, and one without an article, gives an empty text; plain text without markup
is one block and is judged like any other; at equal odds an element is kept; repeated
rows repeat; very deep markup and pages of many MB are handled without recursion, one
page a batch; ids and urls may be null; other columns are ignored, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

PAGES = 400
TREES, DEPTH, RATE, BINS, MIN_WEIGHT = 50, 5, 0.3, 16, 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template iframe object svg canvas select option textarea button audio video map datalist title".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that a head holds; any other ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
#: Which open elements a start tag closes, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
SCOPE = frozenset(["table", "td", "th", "article", "section", "aside", "nav", "footer", "header", "main", "blockquote", "li", "dd", "figure", "form", "div"])

#: Token classes of class, id and role.
TOKENS = {
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs toc pagination pager skip tabs topnav sitenav",
    "ad": "ad ads adv advert advertisement adverts adsense adbox adslot banner sponsor sponsored promo promotion dfp outbrain taboola",
    "comment": "comment comments commentlist disqus discussion responses respond reply replies reader readers",
    "foot": "footer foot bottom copyright colophon legal",
    "head": "header masthead top topbar logo branding sitehead",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast banner warning message subscribe paywall",
    "form": "form search login signin signup newsletter register contact",
    "share": "share sharing social follow facebook twitter buttons tools print",
    "related": "related recommended recommendations more popular trending latest also similar tags tag tagged categories category archive",
    "meta": "meta byline author date time timestamp posted published caption credit",
    "content": "content article post entry story text body main blog news single page hentry",
}
CLASS_OF = {w: k for k, ws in enumerate(TOKENS.values()) for w in ws.split()}
KINDS = [
    ("nav", "menu"), ("header",), ("footer",), ("aside",), ("article",), ("main",), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl"), ("li", "dt", "dd"), ("a",), ("table", "tbody", "thead", "tr", "td", "th"), ("form", "fieldset", "label"), ("blockquote", "pre", "q"), ("figure", "figcaption"), ("html", "body"),
]
KIND_OF = {t: k for k, ts in enumerate(KINDS) for t in ts}
#: Kinds whose presence above an element counts.
ABOVE = [0, 1, 2, 3, 4, 5, 12, 15, 17]
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "tokens", "n")

    def __init__(self, tag: str, parent: Node | None, attrs: list[tuple[str, str | None]]):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        a = dict(attrs) if attrs else {}
        names = " ".join(v for k in ("class", "id", "role", "aria-label") if (v := a.get(k))) if a else ""
        self.tokens = frozenset(CLASS_OF[t] for w in WORD_PARTS.findall(names) if (t := w.lower()) in CLASS_OF) if names else frozenset()
        self.n = 0


#: Tags and token classes of what is no part of an article, even within it.
APART_TAGS = frozenset(["nav", "aside", "footer", "form"])
APART_TOKENS = frozenset(list(TOKENS).index(t) for t in ("nav", "ad", "comment", "foot", "side", "notice", "share"))


def clutter(x: Node) -> bool:
    return x.tag in APART_TAGS or not APART_TOKENS.isdisjoint(x.tokens)


class _Builder(HTMLParser):
    """Builds the tree; parts of a node are its texts and children in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, [])
        self.silent: list[str] = []  # open silent elements
        self.open: dict[str, int] = {}

    def _close(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _speak(self, tag: str) -> None:
        """End the innermost open silent element of a tag, and what is open in it."""
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]

    def _imply(self, tag: str) -> None:
        """End the silent elements whose end tags a start tag implies."""
        if tag == "body" or (self.silent[-1] == "head" and tag not in IN_HEAD):
            self._speak("head")
        elif self.silent[-1] == "option" and tag in ("option", "optgroup"):
            self.silent.pop()
        elif tag in ("input", "textarea"):
            self._speak("select")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            self._imply(tag)
        if tag in ("html", "body"):
            return
        if tag == "select" and tag in self.silent:  # stands for an end tag
            self._speak(tag)
            return
        if self.silent or (tag in SILENT and tag not in VOID):
            if tag in SILENT and not (tag == "head" and self.silent):
                self.silent.append(tag)
            return
        if tag in CLOSES_P and self.open.get("p"):
            x = self.at
            while x is not None and x.tag != "p" and x.tag not in SCOPE:
                x = x.parent
            if x is not None and x.tag == "p":
                self._close(x)
        if tag in IMPLIED:
            closed, stop = IMPLIED[tag]
            x, last = self.at, None
            while x is not None and x.tag not in stop:
                if x.tag in closed:
                    last = x
                x = x.parent
            if last is not None:
                self._close(last)
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent == ["option"] and tag in BLOCK and self.open.get(tag):
            self.silent.pop()
        if self.silent:
            self._speak(tag)
            return
        if not self.open.get(tag):
            return
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None:
            self._close(x)

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and data.strip():
            self.silent.pop()
        if not self.silent:
            self.at.parts.append(data)


def build(html: str) -> list[Node]:
    """The page's elements in order, each before its descendants."""
    b = _Builder()
    b.feed(html)
    b.close()
    out, todo = [], [b.root]
    while todo:
        x = todo.pop()
        x.n = len(out)
        out.append(x)
        todo.extend(reversed(x.children))
    return out


N_FEATURES = len(KINDS) + 2 * len(TOKENS) + len(ABOVE) + 19


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    size, words, marks, link, tags, paras, longest, start = ([0] * n for _ in range(8))
    at = 0
    for x in nodes:
        own = [p.strip() for p in x.parts if isinstance(p, str)]
        text = " ".join(p for p in own if p)
        start[x.n] = at
        size[x.n], words[x.n] = len(text), text.count(" ") + 1 if text else 0
        marks[x.n] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        at += len(text)
        tags[x.n] = 1
    for x in reversed(nodes):
        i = x.n
        if x.tag == "a":
            link[i] = size[i]
        if x.tag == "p":
            paras[i] += 1
            longest[i] = max(longest[i], size[i])
        if x.parent is not None:
            p = x.parent.n
            for a in (size, words, marks, link, tags, paras):
                a[p] += a[i]
            longest[p] = max(longest[p], longest[i])
    total = max(1, size[0])
    rows = []
    apart, inside = [False] * n, [False] * n  # clutter by tag or tokens here or above; an article or main element here or above
    above_kind: list[frozenset] = [frozenset()] * n
    above_token: list[frozenset] = [frozenset()] * n
    depth = [0] * n
    for x in nodes:
        i, parent = x.n, x.parent
        p = parent.n if parent is not None else i
        if parent is not None:
            depth[i] = depth[p] + 1
            above_kind[i] = above_kind[p] | {KIND_OF.get(parent.tag, -1)}
            above_token[i] = above_token[p] | parent.tokens
        apart[i] = clutter(x) or apart[p]
        inside[i] = x.tag in ("article", "main") or inside[p]
        kind, s = KIND_OF.get(x.tag, -1), size[i]
        sib = parent.children if parent is not None else [x]
        row = [0.0] * N_FEATURES
        if kind >= 0:
            row[kind] = 1.0
        o = len(KINDS)
        for t in x.tokens:
            row[o + t] = 1.0
        o += len(TOKENS)
        for t in above_token[i]:
            row[o + t] = 1.0
        o += len(TOKENS)
        for k, v in enumerate(ABOVE):
            if v in above_kind[i]:
                row[o + k] = 1.0
        o += len(ABOVE)
        same = sum(y.tag == x.tag for y in sib) if len(sib) < 64 else len(sib)
        row[o:] = (
            min(depth[i], 20), math.log1p(s), link[i] / max(1, s), math.log1p(words[i]), marks[i] / max(1, words[i]), 100 * tags[i] / (s + 20), min(paras[i], 50), math.log1p(longest[i]),
            start[i] / total, (start[i] + s) / total, s / total, s / max(1, size[p]), link[p] / max(1, size[p]), min(same, 30), len(sib), words[i] / tags[i],
            clutter(x), parent is not None and apart[p], inside[p],
        )
        rows.append(row)
    return np.array(rows, np.float32).reshape(n, N_FEATURES)


# the model


class Trees:
    """Boosted regression trees on binned features for the logistic loss."""

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold, value, in heap order
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        used = [f for f, e in enumerate(edges) if len(e) and (x[:, f] > e[0]).any()]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in used], 1) + np.arange(len(used)) * BINS
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            size = 2 ** (DEPTH + 1) - 1
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            leaf = np.zeros(len(y), np.int64)
            for node in range(size):
                own = np.nonzero(leaf == node)[0]
                if not len(own):
                    continue
                sg, sh = g[own].sum(), h[own].sum()
                value[node] = RATE * sg / (sh + 1)
                if node >= 2**DEPTH - 1 or sh < 2 * MIN_WEIGHT:
                    continue
                b = binned[own]
                cg, ch = (np.cumsum(np.bincount(b.ravel(), np.repeat(w[own], len(used)), len(used) * BINS).reshape(-1, BINS), 1) for w in (g, h))
                gain = cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1)
                gain[(ch < MIN_WEIGHT) | (sh - ch < MIN_WEIGHT)] = 0
                f, k = divmod(int(np.argmax(gain)), BINS)
                if gain[f, k] > 1e-6:
                    feature[node], threshold[node] = used[f], edges[used[f]][k]
                    leaf[own] = 2 * node + 1 + (b[:, f] > f * BINS + k)
            score += value[leaf]
            self.trees.append((feature, threshold.astype(np.float32), value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = f >= 0
                at = np.where(go, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > threshold[at]), at)
            out += value[at]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the likeliest labels under which nothing dropped holds anything kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = yes.tolist(), no.tolist()
    for x in reversed(nodes):
        if x.parent is not None:
            keep[x.parent.n] += max(keep[x.n], drop[x.n])
            drop[x.parent.n] += drop[x.n]
    out = [True] * len(nodes)
    for x in nodes:
        out[x.n] = (x.parent is None or out[x.parent.n]) and (x.parent is None or keep[x.n] > drop[x.n])
    return out


def render(nodes: list[Node], kept: list[bool]) -> str:
    """The kept elements' text, block by block."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

    todo: list = [nodes[0]]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            block = x.tag in BLOCK
            if block:
                flush()
            if kept[x.n]:
                if block:
                    todo.append(None)
                todo.extend(reversed(x.parts))
    flush()
    return " ".join(blocks)


# training pages


def _words(r: random.Random, a: int, b: int) -> str:
    n = r.randint(a, b)
    out = ["".join(r.choice("bcdfghlmnprstvwz") + r.choice("aeiouäé") for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(out)


def _sentences(r: random.Random, a: int, b: int) -> str:
    return " ".join(_words(r, 3, 18).capitalize() + r.choice("....!?") for _ in range(r.randint(a, b)))


def _list(r: random.Random, a: int, b: int, link: bool = True) -> str:
    items = [_words(r, 1, 4) for _ in range(r.randint(a, b))]
    return "<ul>" + "".join(f'<li><a href="/{n}">{t}</a></li>' if link else f"<li>{t}</li>" for n, t in enumerate(items)) + "</ul>"


def _clutter(r: random.Random, kind: str) -> str:
    c = lambda *names: r.choice(names)
    if kind == "nav":
        return c(f"<nav>{_list(r, 3, 9)}</nav>", f'<div class="{c("menu", "navbar", "main-nav", "breadcrumbs", "pagination")}">{_list(r, 2, 9)}</div>', f'<ul class="{c("menu", "nav", "topnav")}">{_list(r, 3, 8)[4:]}', f'<div id="nav"><a href="/">{_words(r, 1, 2)}</a> | <a href="/b">{_words(r, 1, 2)}</a></div>')
    if kind == "head":
        return c(f"<header><h1>{_words(r, 1, 3)}</h1><p>{_words(r, 2, 8)}</p>{c('', _clutter(r, 'nav'))}</header>", f'<div id="{c("header", "masthead", "top", "site-header")}"><a href="/">{_words(r, 1, 3)}</a><p>{_words(r, 2, 7)}</p></div>', f"<header>{_words(r, 2, 12)}</header>")
    if kind == "foot":
        t = c(f"&copy; {_words(r, 2, 6)} &middot; {_sentences(r, 1, 2)}", f"<p>{_sentences(r, 1, 3)}</p>{_list(r, 2, 6)}", f"<p>Copyright {_words(r, 2, 8)}</p>")
        return c(f"<footer>{t}</footer>", f'<div class="{c("footer", "site-footer", "copyright", "bottom")}">{t}</div>', f'<div id="footer">{t}</div>')
    if kind == "ad":
        t = c(_sentences(r, 1, 3), f"<p>{_sentences(r, 1, 2)}</p>", f'<a href="http://x">{_words(r, 3, 9)}</a>', f"<h3>{_words(r, 2, 5)}</h3><p>{_sentences(r, 1, 2)}</p>")
        return f'<{(g := c("div", "div", "aside", "section"))} class="{c("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "banner-ad")}">{t}</{g}>'
    if kind == "side":
        t = f"<h3>{_words(r, 1, 3)}</h3>" + c(_list(r, 3, 8), f"<p>{_sentences(r, 1, 4)}</p>", f"<p>{_sentences(r, 1, 2)}</p>{_list(r, 2, 5)}")
        return c(f"<aside>{t}</aside>", f'<div class="{c("sidebar", "side", "widget", "related", "related-posts", "right-rail", "popular")}">{t}</div>', f'<div id="sidebar">{t}</div>', f'<aside class="sidebar">{t}</aside>')
    if kind == "notice":
        t = c(_sentences(r, 1, 3), f"<p>{_sentences(r, 1, 3)}</p><a href='#'>{_words(r, 1, 2)}</a>", f"<p>{_sentences(r, 1, 2)}</p><button>{_words(r, 1, 2)}</button>")
        return f'<div {c("class", "id")}="{c("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "popup", "alert", "cookies", "paywall-message")}">{t}</div>'
    if kind == "form":
        return f'<form{c("", " class=search", " id=newsletter", " action=/s")}>{c("", f"<p>{_sentences(r, 1, 2)}</p>")}<label>{_words(r, 1, 4)}</label><input name=q><button>{_words(r, 1, 2)}</button></form>'
    if kind == "share":
        return f'<div class="{c("share", "social", "share-buttons", "follow-us", "tags")}">{c(_words(r, 1, 5), _list(r, 2, 5))}</div>'
    talk = lambda: c(f'<div class="comment"><p class="author">{_words(r, 1, 2)}</p><p>{_sentences(r, 1, 5)}</p></div>', f"<p><b>{_words(r, 1, 2)}</b> {_sentences(r, 1, 4)}</p>", f"<li>{_sentences(r, 1, 4)}</li>", f'<article class="comment"><p>{_sentences(r, 1, 4)}</p></article>', f"<div>{_sentences(r, 1, 3)}</div>")
    return f'<{(g := c("div", "section", "section", "ol"))} {c("class", "id")}="{c("comments", "comments", "comment-list", "comments-area", "responses", "disqus_thread", "reader-comments")}">{c("", f"<h3>{_words(r, 1, 2)}</h3>")}{"".join(talk() for _ in range(r.randint(1, 5)))}</{g}>'


def _story(r: random.Random, inside: bool) -> str:
    """An article's blocks; what is no part of it carries data-x."""
    mark = lambda html: re.sub(r"^<(\w+)", r"<\1 data-x=1", html)
    out = [f"<h1>{_words(r, 3, 12)}</h1>"] if r.random() < 0.9 else []
    if out and r.random() < 0.2:
        out = [f"<header>{out[0]}</header>"]
    if r.random() < 0.3:
        out.append(f"<p><b>{_sentences(r, 1, 2)}<br><p>{_sentences(r, 1, 5)}</p>")
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        k = r.random()
        if k < 0.72:
            out.append(f"<p>{_sentences(r, 1, 7)}" + (f' <a href="/x">{_words(r, 1, 4)}</a> {_words(r, 2, 9)}.' if r.random() < 0.25 else "") + "</p>")
        elif k < 0.8:
            out.append(f"<h{(n := r.choice('234'))}>{_words(r, 1, 7)}</h{n}>")
        elif k < 0.86:
            out.append("<ul>" + "".join(f"<li>{_sentences(r, 1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif k < 0.89:
            out.append(f"<blockquote><p>{_sentences(r, 1, 3)}</p></blockquote>")
        elif k < 0.92:
            out.append("<table><tr>" + "".join(f"<td>{_words(r, 1, 4)}</td>" for _ in range(3)) + "</tr></table>")
        elif k < 0.94:
            out.append(f"<div>{_sentences(r, 1, 4)}</div>")
        elif k < 0.96:
            out.append(f"<figure><img src=x><figcaption>{_words(r, 3, 10)}</figcaption></figure>")
        elif inside:
            out.append(mark(_clutter(r, r.choice(["ad", "ad", "share", "form", "side", "notice"]))))
    if r.random() < 0.1:
        out.append(f"<p>{_words(r, 1, 3)}.</p>")
    return "".join(out)


def generate(seed: int) -> str:
    """A page whose article stands in elements with data-y; what it holds besides carries data-x."""
    r = random.Random(seed)
    put = lambda kind, p: _clutter(r, kind) if r.random() < p else ""
    wrap = r.choice(
        ["<article data-y=1>%s</article>"] * 5
        + ["<main data-y=1>%s</main>", "<main><article data-y=1>%s</article></main>", '<div class="post" data-y=1>%s</div>', '<div class="article-body" data-y=1>%s</div>', '<div class="entry-content" data-y=1>%s</div>', '<div id="content" data-y=1>%s</div>', '<div class="story" data-y=1>%s</div>', "<section data-y=1>%s</section>", "<div data-y=1>%s</div>", "<table><tr><td data-y=1>%s</td></tr></table>"]
    )
    story = wrap % (_story(r, True) + ((lambda t: re.sub(r"^<(\w+)", r"<\1 data-x=1", t))(_clutter(r, "comment")) if r.random() < 0.12 else ""))
    before = [put("notice", 0.3), put("head", 0.35), put("nav", 0.75), put("ad", 0.45), put("side", 0.15), put("form", 0.15)]
    after = [put("share", 0.25), put("ad", 0.2), put("comment", 0.4), put("side", 0.35), put("nav", 0.15), put("form", 0.2), put("foot", 0.85), put("notice", 0.15)]
    if r.random() < 0.3:
        r.shuffle(before)
    middle = story + "".join(after[:3])
    if r.random() < 0.3:
        middle = f'<div class="{r.choice(["wrapper", "container", "page", "row", "main", "content"])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{''.join(before)}<!-- c -->{middle}{''.join(after[3:])}</body></html>"


def label(nodes: list[Node], marks: list[str]) -> np.ndarray:
    """1 where the subtree holds text of the article: y marks the article, x what is in it but no part of it."""
    state, out = [0] * len(nodes), np.zeros(len(nodes))
    for x in nodes:
        up = state[x.parent.n] if x.parent is not None else 0
        state[x.n] = -1 if up < 0 or (up > 0 and marks[x.n] == "x") else 1 if up > 0 or marks[x.n] == "y" else 0
        out[x.n] = state[x.n] > 0
    for x in reversed(nodes):
        if out[x.n] and x.parent is not None:
            out[x.parent.n] = 1
    return out


def generated(seed: int) -> tuple[list[Node], np.ndarray]:
    """A generated page and its labels; the marks are not part of the page."""
    html = generate(seed)
    nodes = build(re.sub(" data-[xy]=1", "", html))
    return nodes, label(nodes, _marks(html))


def _training() -> tuple[np.ndarray, np.ndarray]:
    found = [generated(seed) for seed in range(PAGES)]
    return np.concatenate([features(n) for n, _ in found]), np.concatenate([y for _, y in found])


def _marks(html: str) -> list[str]:
    """Of each element of a generated page its mark, in the order of build()."""

    class Reader(_Builder):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            before = self.at
            many = len(before.children)
            super().handle_starttag(tag, attrs)
            a = dict(attrs)
            made = self.at if self.at is not before else before.children[-1] if len(before.children) > many else None
            if made is not None and made.tag == tag:
                names[id(made)] = "x" if "data-x" in a else "y" if "data-y" in a else ""

    names: dict[int, str] = {}
    b = Reader()
    b.feed(html)
    b.close()
    out, todo = [], [b.root]
    while todo:
        x = todo.pop()
        out.append(names.get(id(x), ""))
        todo.extend(reversed(x.children))
    return out


@lru_cache(maxsize=1)
def model() -> Trees:
    return Trees().fit(*_training())


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    built = [build(h) if h else [] for h in pages]
    some = [b for b in built if b]
    odds = trees.log_odds(np.concatenate([features(b) for b in some])) if some else np.zeros(0)
    out, at = [], 0
    for b in built:
        out.append(render(b, decode(b, odds[at : at + len(b)])) if b else "")
        at += len(b)
    return out


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def extract_text(df: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for (page_id, url, html)."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(trees or model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column(2).to_pylist(), sent.value)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(df.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, RESULT)


def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
