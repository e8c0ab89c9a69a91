"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block elements with the runs of text between them as leaves.
Every node is content or not. Weights of its own features (names, words of class, id and role,
amount of text, links, sentences) give a node's potential, a table for each kind of edge the
potential of parent and child. Messages up and down the tree (sum-product) give the exact
probability of content for every node; runs that are likelier content than not are the text.

The weights maximise the likelihood of labelled pages (``labelled_pages``), with the same
messages giving the gradient. Pages of a batch are one forest; nodes of one depth are handled
together.

Null and empty pages, and pages without text, give the empty text. Unclosed and misnested
tags are closed where a browser would need to; a page cut off anywhere is read to its end.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names, fixed values: blocks, elements whose inside is no text, elements without an end,
#: and which open elements a start tag closes.
BLOCKS = frozenset(
    "html head title body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend label button "
    "select option address details summary hr center dialog menu noscript template svg object".split()
)
RAW = frozenset("script style iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
PARAGRAPH_ENDS = BLOCKS - {
    "label", "button", "select", "option", "html", "head", "title", "body", "noscript", "template", "svg", "object",
}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")

FEATURES = 1 << 12


@dataclass
class Tree:
    """Nodes of one page in page order; a leaf has a text, an element a tag."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    marked: list[bool] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: list[str], text: str | None, linked: int, marked: bool) -> int:
        self.parent.append(parent)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.marked.append(marked)
        return len(self.parent) - 1


def parse(page: str, marker: str | None = None) -> Tree:
    """Tree of a page. Elements with the attribute ``marker`` mark all text in them (for labelled pages)."""
    tree = Tree()
    open_: list[tuple[str, int]] = [("", tree.add(-1, "root", [], None, 0, False))]
    run: list[str] = []
    linked = 0
    in_link = 0

    def end_run() -> None:
        nonlocal run, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            top = open_[-1][1]
            tree.add(top, "#text", [], text, min(linked, len(text)), tree.marked[top])
        run, linked = [], 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            if in_link:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
        if name == "br":
            put(" ")
        if name not in BLOCKS:
            continue
        end_run()
        in_link = 0 if name != "a" and not m[1] and name in PARAGRAPH_ENDS else in_link
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            continue
        if name in PARAGRAPH_ENDS and any(n == "p" for n, _ in open_[-3:]):
            while open_[-1][0] != "p":
                open_.pop()
            open_.pop()
        if name in CLOSES:
            shut, within = CLOSES[name]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in within:
                    break
                if open_[k][0] in shut:
                    del open_[k:]
                    break
        if name in VOID or name == "svg" and m[3].endswith("/"):
            continue
        names = [w for a, x, y, z in _NAMES.findall(m[3]) for w in (_PART.findall((x or y or z).lower()) or [a.lower()])]
        top = open_[-1][1]
        mark = tree.marked[top] or (marker is not None and marker in m[3])
        open_.append((name, tree.add(top, name, names, None, 0, mark)))
    end_run()
    return tree


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


_SLOTS: dict[str, int] = {}


def _slots(names: list[str]) -> list[int]:
    out = []
    for n in names:
        if n not in _SLOTS:
            if len(_SLOTS) > 100_000:
                _SLOTS.clear()
            _SLOTS[n] = _slot(n)
        out.append(_SLOTS[n])
    return out


def _bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def features(tree: Tree) -> list[list[int]]:
    """Active features of every node."""
    n = len(tree.parent)
    chars, links, leaves, sentences = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        text = tree.text[k]
        if text is not None:
            chars[k], links[k], leaves[k] = len(text), tree.linked[k], 1
            sentences[k] = 1 if _SENTENCE.search(text) else 0
        p = tree.parent[k]
        if p >= 0:
            chars[p] += chars[k]
            links[p] += links[k]
            leaves[p] += leaves[k]
            sentences[p] += sentences[k]
    total = max(1, chars[0])
    out = []
    for k in range(n):
        p = tree.parent[k]
        share = 4 * links[k] // max(1, chars[k])
        kind = "t" if tree.text[k] is not None else "e"
        names = [
            f"{kind}:bias", f"{kind}:links{share}", f"{kind}:chars{_bucket(chars[k])}",
            f"{kind}:sent{5 * sentences[k] // max(1, leaves[k])}", f"{kind}:part{8 * chars[k] // total}",
        ]
        if kind == "t":
            names.append(f"in:{tree.tag[p]}")
        else:
            names.append(f"tag:{tree.tag[k]}")
            names.append(f"mean{_bucket(chars[k] // max(1, leaves[k]))}")
            names += [f"name:{w}" for w in tree.names[k]]
        out.append(_slots(names))
    return out


def marginals(parent: np.ndarray, depth: np.ndarray, leaf: np.ndarray, unary: np.ndarray, edge: np.ndarray):
    """Probability of content of every node of a forest, and of the state pairs of every edge.

    ``unary`` is nodes x 2 and ``edge`` kinds x parent state x child state, as logarithms;
    nodes of a depth are handled together, first leaves to roots, then back.
    """
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    up = np.zeros((n, 2))  # message of a node to its parent
    gathered = unary.copy()
    for level in reversed(levels[1:]):
        joint = edge[leaf[level]] + gathered[level][:, None, :]
        top = joint.max(axis=2)
        up[level] = top + np.log(np.exp(joint - top[:, :, None]).sum(axis=2))
        for s in (0, 1):
            gathered[:, s] += np.bincount(parent[level], up[level, s], n)
    belief = gathered.copy()
    pairs = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = belief[parent[level]] - up[level]
        joint = above[:, :, None] + edge[leaf[level]] + gathered[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        weight = np.exp(joint)
        weight /= weight.sum(axis=(1, 2), keepdims=True)
        pairs[level] = weight
        belief[level] = np.log(np.maximum(weight.sum(axis=1), 1e-300))
    belief -= belief.max(axis=1, keepdims=True)
    state = np.exp(belief)
    return state[:, 1] / state.sum(axis=1), pairs


@dataclass(frozen=True)
class ContentModel:
    weights: np.ndarray
    edge: np.ndarray


def _forest(trees: list[Tree]):
    sizes = [len(t.parent) for t in trees]
    begins = np.cumsum([0, *sizes])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + b) for t, b in zip(trees, begins)])
    depth = np.concatenate([np.array(t.depth) for t in trees])
    leaf = np.concatenate([np.array([x is not None for x in t.text], np.int64) for t in trees])
    active = [f for t in trees for f in features(t)]
    node = np.repeat(np.arange(len(active)), [len(f) for f in active])
    return begins, parent, depth, leaf, node, np.array([x for f in active for x in f], np.int64)


def fit_content_model(pages: list[str], marker: str = "data-content", rounds: int = 200, penalty: float = 0.5) -> ContentModel:
    """Weights of the highest likelihood for pages whose content is marked by an attribute."""
    trees = [parse(p, marker) for p in pages]
    _, parent, depth, leaf, node, feature = _forest(trees)
    n = len(parent)
    marked = np.array([m for t in trees for m in t.marked])
    chars = np.array([len(x or "") for t in trees for x in t.text], float)
    inside = np.where(leaf == 1, chars * marked, 0.0)
    for d in range(depth.max(), 0, -1):  # an element is content if most of its text is
        level = np.flatnonzero(depth == d)
        chars += np.bincount(parent[level], chars[level], n)
        inside += np.bincount(parent[level], inside[level], n)
    label = np.where(leaf == 1, marked, inside > 0.5 * chars).astype(int)
    child = np.flatnonzero(parent >= 0)
    weights, edge = np.zeros(FEATURES), np.zeros((2, 2, 2))
    seen = np.bincount(feature, label[node], FEATURES)
    want = np.zeros((2, 2, 2))
    np.add.at(want, (leaf[child], label[parent[child]], label[child]), 1)
    m = [np.zeros_like(weights), np.zeros_like(edge)]
    v = [np.zeros_like(weights), np.zeros_like(edge)]
    for step in range(1, rounds + 1):
        unary = np.stack([np.zeros(n), np.bincount(node, weights[feature], n)], axis=1)
        p, pairs = marginals(parent, depth, leaf, unary, edge)
        grads = [seen - np.bincount(feature, p[node], FEATURES) - penalty * weights, want.copy() - penalty * edge]
        np.subtract.at(grads[1], leaf[child], pairs[child])
        for k, (x, g) in enumerate(zip((weights, edge), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ContentModel(weights, edge)


def extract_texts(pages: list[str], model: ContentModel) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    begins, parent, depth, leaf, node, feature = _forest(trees)
    n = len(parent)
    unary = np.stack([np.zeros(n), np.bincount(node, model.weights[feature], n)], axis=1)
    likely = marginals(parent, depth, leaf, unary, model.edge)[0] > 0.5
    return [
        "\n".join(x for x, ok in zip(t.text, likely[b : b + len(t.parent)]) if ok and x is not None)
        for t, b in zip(trees, begins)
    ]


def _extractor(model: ContentModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract_texts(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def extract_pages(pages: DataFrame, model: ContentModel) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html); no shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extractor(model), "page_id long, url string, text string, n_chars long")


#: Names that site templates give their parts; examples for the labelled pages.
PART_NAMES = {
    "content": ("content", "post", "entry", "article-body", "story", "main-text", "post-content", "text", "body-copy"),
    "nav": ("nav", "menu", "navbar", "breadcrumb", "topnav", "navigation", "tabs", "pager"),
    "header": ("header", "masthead", "site-top", "branding", "topbar", "logo"),
    "side": ("sidebar", "widget", "aside", "related", "recommended", "rail", "popular", "tags", "toc", "more-stories"),
    "ad": ("ad", "ads", "advert", "sponsor", "banner", "promo", "advertisement", "sponsored"),
    "notice": ("cookie", "notice", "consent", "alert", "gdpr", "popup", "subscribe-box", "paywall", "disclaimer"),
    "form": ("form", "search", "newsletter", "login", "signup", "contact-form"),
    "comments": ("comments", "comment-list", "discussion", "replies", "responses", "reader-comments", "disqus"),
    "share": ("share", "social", "follow", "buttons"),
    "footer": ("footer", "site-bottom", "copyright", "legal", "imprint", "colophon"),
}


def labelled_pages(count: int = 800, seed: int = 11) -> list[str]:
    """Pages of many layouts whose content carries the attribute data-content.

    Layouts vary in semantic elements, names, nesting, place and size of the parts; the text is
    invented. ``count`` bounds the training sample.
    """
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "on", "el", "sa", "ver", "ing", "o", "qu", "lu", "ben", "dra", "th", "es", "po"]

    def words(low: int, high: int, end: str = "") -> str:
        out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(out).capitalize() + end

    def prose(most: int = 6) -> str:
        return " ".join(words(3, 25, rng.choice(".....?!")) for _ in range(rng.randint(1, most)))

    def links(low: int, high: int) -> str:
        short = rng.random() < 0.2
        items = [f'<a href="/{words(1, 1)}">{rng.choice(syllables)[: rng.randint(1, 3)] if short else words(1, 4)}</a>' for _ in range(rng.randint(low, high))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return rng.choice((" | ", " ", "<br>")).join(items)

    def box(part: str, inner: str, tags: tuple[str, ...], named: float, extra: str = "") -> str:
        tag = rng.choice(tags)
        names = rng.choice(PART_NAMES[part]) if part in PART_NAMES and (tag == "div" or rng.random() < 0.4) and rng.random() < named else ""
        attr = f' {rng.choice(("class", "class", "id"))}="{names}"' if names else ""
        return f"<{tag}{attr}{extra}>{inner}</{tag}>"

    def paragraph() -> str:
        if rng.random() < 0.08:
            return "<p>" + words(1, 3, ".") + rng.choice(("</p>", "</p>", ""))
        text = prose()
        if rng.random() < 0.3:
            text = re.sub(r" (\S+) ", r' <a href="/x">\1</a> ', text, count=1)
        return "<p>" + (f"<b>{text}<br>" if rng.random() < 0.15 else f"{text}</p>")

    def body_blocks() -> str:
        out = [paragraph() for _ in range(rng.choice((1, 2, 3, 5, 8, 12)))]
        if rng.random() < 0.35:
            out.insert(rng.randrange(len(out) + 1), f"<h2>{words(2, 6)}</h2>")
        if rng.random() < 0.25:
            out.append("<ul>" + "".join(f"<li>{prose(2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        if rng.random() < 0.15:
            out.append(f"<blockquote>{prose(2)}</blockquote>")
        if rng.random() < 0.1:
            out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        if rng.random() < 0.1:
            out.append(f"<pre>{words(3, 9)}</pre>")
        return "".join(out)

    def aside(named: float) -> str:
        kind = rng.random()
        if kind < 0.4:
            return box("side", f"<h3>{words(1, 3)}</h3>" + links(3, 9), ("aside", "div"), max(named, 0.5))
        if kind < 0.7:
            return box("ad", rng.choice((prose(1), words(3, 9), f'<a href="/ad">{words(3, 8)}</a>', f"<p>{prose(2)}</p>")), ("div", "div", "aside"), 1.0)
        if kind < 0.85:
            return box("notice", f"<p>{prose(2)}</p>" + rng.choice(("", f"<button>{words(1, 2)}</button>")), ("div", "section", "aside", "dialog"), 1.0)
        return box("form", f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + rng.choice(("", f"<p>{prose(1)}</p>")), ("form",), named)

    def comments(named: float) -> str:
        one = lambda: rng.choice((
            f'<li><b>{words(1, 2)}</b> {prose(3)}</li>', f'<div class="comment"><span>{words(1, 2)}</span><p>{prose(3)}</p></div>', f"<p>{words(1, 2)}: {prose(2)}</p>",
        ))
        return box("comments", f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 8))), ("section", "div", "div", "aside"), 1.0)

    def page() -> str:
        named = rng.choice((0.0, 0.5, 1.0))
        mark = " data-content"
        title = f"<h1>{words(2, 10, rng.choice(('', '.')))}</h1>"
        inner = title + body_blocks()
        if rng.random() < 0.25:
            cut = inner.find("</p>") + 4 if "</p>" in inner else len(title)
            inner = f"<div{mark}>{inner[:cut]}</div>" + aside(1.0) + f"<div{mark}>{inner[cut:]}</div>"
            content = box("content", inner, ("article", "main", "div"), 1.0)
        else:
            shape = rng.random()
            if shape < 0.55:
                content = box("content", inner, ("article", "article", "main", "section"), named, mark)
            elif shape < 0.85:
                content = box("content", inner, ("div",), max(named, 0.7), mark)
            else:
                content = f"<table><tr><td>{links(3, 8)}</td><td{mark}>{inner}</td></tr></table>"
        if rng.random() < 0.3:
            content = content + comments(named)
        elif rng.random() < 0.15 and mark not in inner:
            content = f"<article><div{mark}>{inner}</div>{comments(1.0)}</article>"
        if rng.random() < 0.4:
            content = rng.choice(("<main>{}</main>", "<div>{}</div>", '<div id="page">{}</div>', '<div class="wrapper"><div class="row">{}</div></div>')).format(content)
        parts = []
        if rng.random() < 0.4:
            parts.append(box("header", rng.choice((f"<a href='/'>{words(1, 3)}</a>", f"<p>{words(2, 7)}</p>", f"<h2>{words(1, 3)}</h2>")) + rng.choice(("", links(2, 6))), ("header", "div"), max(named, 0.7)))
        if rng.random() < 0.8:
            parts.append(box("nav", links(3, 10), ("nav", "nav", "div"), max(named, 0.6)))
        parts += [aside(named) for _ in range(rng.choice((0, 0, 1, 2)))]
        parts.append(content)
        parts += [aside(named) for _ in range(rng.choice((0, 0, 1, 2)))]
        if rng.random() < 0.25:
            parts.append(box("share", links(2, 5), ("div",), 1.0))
        if rng.random() < 0.8:
            parts.append(box("footer", rng.choice((f"&copy; {words(1, 3)} &middot; {words(3, 12, '.')}", f"<p>{prose(2)}</p>", links(2, 8))), ("footer", "footer", "div"), max(named, 0.8)))
        head = f"<head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head>"
        end = "</body></html>" if rng.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}{end}"

    return [page() for _ in range(count)]
