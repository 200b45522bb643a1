"""Main text of web pages by boosted trees over DOM nodes.

A node (a block element, or an inline one with a class, id or role) is
described by its tag, attribute tokens, depth, subtree text and link density
and statistics of its siblings.  Gradient-boosted trees give the probability
that its subtree holds text of the article.  Decoding chooses, for the whole
tree at once, the likeliest labels in which no node below a rejected one is
accepted (dynamic programming from the leaves), so ancestors and descendants
never contradict each other.

Training uses a bounded sample of ``SAMPLE`` pages, the smallest md5 of their
id.  Pages with one ``article`` or ``main`` element are labelled by it, and
their text is set again into pages of known parts: menus, headers, footers,
side columns, notices, adverts, forms and reader comments around and inside
an article, marked up in varied ways.

Defined results: null html is the empty page; a page without article text
gives the empty text and 0; rows are independent, so ties, repeated rows,
null ids and extra columns do not matter; whole pages of any length are
parsed; an empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .html_dom import N_FEATURES, Page

SAMPLE = 240
VARIANTS = 6
TREES, DEPTH, BINS, RATE, SHRINK = 60, 4, 32, 0.2, 1.0
PAGES = 128  # pages whose nodes are scored together


class Forest:
    """Boosted complete trees of ``DEPTH`` levels for a binary label."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)
        n, width = bins.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees = []
        z = np.full(n, self.base)
        cell = np.arange(width) * BINS + bins
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, dtype=np.int64)
            feature, threshold = [], []
            for level in range(DEPTH):
                f, t = self._splits(cell, at, g, h, 2 ** level, width)
                feature.append(f)
                threshold.append(np.array([self._value(a, b) for a, b in zip(f, t)]))
                at = 2 * at + (bins[np.arange(n), f[at]] > t[at])
            size = 2 ** DEPTH
            leaf = -RATE * np.bincount(at, g, size) / (np.bincount(at, h, size) + SHRINK)
            z += leaf[at]
            self.trees.append((feature, threshold, leaf))

    def _value(self, feature: int, cut: int) -> float:
        edges = self.edges[feature]
        return float(edges[cut]) if cut < len(edges) else np.inf

    @staticmethod
    def _splits(cell, at, g, h, nodes, width):
        """The best (feature, bin) of each node of a level."""
        flat = (at[:, None] * (width * BINS) + cell).ravel()
        shape = (nodes, width, BINS)
        size = nodes * width * BINS
        left_g = np.bincount(flat, np.repeat(g, width), size).reshape(shape).cumsum(axis=2)
        left_h = np.bincount(flat, np.repeat(h, width), size).reshape(shape).cumsum(axis=2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        gain = left_g ** 2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK)
        best = gain.reshape(nodes, -1).argmax(axis=1)
        return best // BINS, best % BINS

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for f, t in zip(feature, threshold):
                at = 2 * at + (x[rows, f[at]] > t[at])
            z += leaf[at]
        return z


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which every kept node's parent is kept."""
    nodes = page.nodes
    order = {id(n): i for i, n in enumerate(nodes)}
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    mute = np.array([n.silent or not n.chars for n in nodes])
    keep[mute] = drop[mute] = 0.0
    best, gone = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = order[id(nodes[i].parent)]
        best[up] += max(best[i], gone[i])
        gone[up] += gone[i]
    kept = [True] * len(nodes)
    for i, node in enumerate(nodes):
        above = kept[order[id(node.parent)]] if node.parent is not None else True
        kept[i] = above and bool(best[i] > gone[i])
    return kept


# --------------------------------------------------------------- training pages

MAIN_NAMES = ["content", "article-body", "post-content", "entry-content", "story", "main-content", "post", "text",
              "", "", "", "", "", "x2", "c-1"]
OUTER_NAMES = ["wrapper", "container", "page", "site", "row", "col", "layout", "", ""]
PARTS = {
    "nav": (["nav", "div", "ul"], ["nav", "main-menu", "breadcrumbs", "navbar", "topnav", "pagination"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "topbar"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "legal"]),
    "side": (["aside", "div", "section"], ["sidebar", "widget", "related", "recommended-posts", "right-rail", "popular"]),
    "ad": (["div", "section", "aside"], ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"]),
    "notice": (["div", "section", "p"], ["notice", "cookie-notice", "alert", "consent", "popup", "gdpr-message"]),
    "form": (["form", "div"], ["newsletter", "subscribe-form", "search-form", "login", "contact-form", "signup"]),
    "social": (["div", "ul"], ["share", "social-links", "share-buttons", "follow-us"]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "reader-comments", "disqus", "responses-replies"]),
}


def _words(rng, texts, lo, hi):
    words = rng.choice(texts).split() or ["word"]
    n = rng.randint(lo, hi)
    at = rng.randrange(max(1, len(words) - n))
    return " ".join(words[at:at + n]).replace("<", "&lt;")


def _part(rng, texts, kind: str) -> str:
    tags, names = PARTS[kind]
    tag = rng.choice(tags)
    plain = tag not in ("div", "section", "p", "ul", "ol") and rng.random() < 0.4
    attr = "" if plain else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
    link = lambda: f'<a href="/x">{_words(rng, texts, 1, 3)}</a>'
    if kind in ("nav", "social"):
        items = [link() for _ in range(rng.randint(2, 8))]
        body = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" or rng.random() < 0.5 else " | ".join(items)
        body = f"<ul>{body}</ul>" if tag != "ul" and body.startswith("<li") else body
    elif kind == "comments":
        name = rng.choice(["comment", "comment-body", "reply", "comment-item", ""])
        body = f"<h3>{_words(rng, texts, 1, 3)}</h3>" * rng.randint(0, 1)
        for _ in range(rng.randint(1, 5)):
            text = f"<p>{_words(rng, texts, 3, 80)}</p>" if rng.random() < 0.7 else _words(rng, texts, 3, 80)
            inner = rng.choice(["li", "div", "article"]) if tag != "ol" else "li"
            body += f'<{inner} class="{name}">{text}</{inner}>' if name else f"<{inner}>{text}</{inner}>"
    elif kind == "form":
        body = f"<label>{_words(rng, texts, 1, 6)}</label><input name='q'><p>{_words(rng, texts, 2, 15)}</p>"
    elif kind == "header":
        body = rng.choice([f"<h1>{_words(rng, texts, 1, 5)}</h1>", link(), f"<p>{_words(rng, texts, 2, 10)}</p>"])
    elif kind == "footer":
        body = f"&copy; {_words(rng, texts, 2, 25)}" if rng.random() < 0.6 else f"<p>{_words(rng, texts, 2, 40)}</p>" + link()
    elif kind == "side":
        body = f"<h3>{_words(rng, texts, 1, 4)}</h3>" + "".join(
            rng.choice([f"<p>{_words(rng, texts, 4, 40)}</p>", f"<li>{link()}</li>"]) for _ in range(rng.randint(1, 5)))
    else:
        body = _words(rng, texts, 2, 60) if rng.random() < 0.6 else f"<p>{_words(rng, texts, 2, 60)}</p>"
    return f'<{tag}{attr} data-part="0">{body}</{tag}>'


def _article(rng, texts, blocks: list[str]) -> str:
    out = []
    for i, b in enumerate(blocks):
        b = b.replace("&", "&amp;").replace("<", "&lt;")
        if i == 0:
            out.append(f"<h1>{b}</h1>" if rng.random() < 0.9 else f"<header><h1>{b}</h1></header>")
            continue
        kind = rng.random()
        if kind < 0.8:
            out.append(f"<p>{b}</p>" if rng.random() < 0.85 else f"<p><b>{b}<br>")
        elif kind < 0.85:
            out.append(f"<blockquote>{b}</blockquote>")
        elif kind < 0.9:
            out.append(f"<ul><li>{b}</li><li>{_words(rng, texts, 1, 12)}</li></ul>")
        elif kind < 0.95:
            out.append(f"<h2>{_words(rng, texts, 1, 6)}</h2><p>{b}</p>")
        else:
            out.append(f"<div>{b}</div>")
        if rng.random() < 0.1:
            out.append(_part(rng, texts, rng.choice(["ad", "side", "social", "notice", "form"])))
    if rng.random() < 0.4:
        out.append(_part(rng, texts, rng.choice(["comments", "comments", "footer", "footer", "social", "side", "form"])))
    tag = rng.choice(["article", "article", "main", "div", "section"])
    name = rng.choice(MAIN_NAMES)
    attr = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
    body = "".join(out)
    if rng.random() < 0.3:
        body = f"<div class='{rng.choice(OUTER_NAMES)}'>{body}</div>"
    return f'<{tag}{attr} data-part="1">{body}</{tag}>'


def training_page(rng: random.Random, texts: list[str], blocks: list[str]) -> str:
    """A page of known parts: ``data-part`` is 1 for the article, 0 for others."""
    some = lambda *kinds: "".join(_part(rng, texts, k) for k in kinds if rng.random() < 0.5)
    body = some("notice", "header", "nav", "ad", "social", "side", "form") + _article(rng, texts, blocks) + some(
        "ad", "side", "comments", "social", "form", "notice", "footer")
    for _ in range(rng.randint(0, 2)):
        body = f'<div class="{rng.choice(OUTER_NAMES)}">{body}</div>'
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labels(page: Page, default: str = "0") -> np.ndarray:
    """Whether a node's subtree holds text whose nearest mark is 1."""
    inside: dict[int, str] = {}
    for n in page.nodes:
        inside[id(n)] = n.part or inside.get(id(n.parent), default)
    positive = {id(n) for n, text, _ in page.pieces if inside[id(n)] == "1" and not text.isspace()}
    out = np.zeros(len(page.nodes), dtype=bool)
    order = {id(n): i for i, n in enumerate(page.nodes)}
    for i in range(len(page.nodes) - 1, -1, -1):
        n = page.nodes[i]
        out[i] |= id(n) in positive
        if out[i] and n.parent is not None:
            out[order[id(n.parent)]] = True
    return out


def seeded(page: Page) -> bool:
    """Mark a page that has exactly one article or main element by it."""
    seeds = [n for n in page.nodes if n.tag in ("article", "main")]
    if len(seeds) == 1:
        seeds[0].part = "1"
        for n in page.nodes:
            if n.tag in ("nav", "aside", "footer", "form") or set(n.hints) - {"main"}:
                n.part = "0"
    return len(seeds) == 1


def train(sources: list[str], seed: int = 9) -> Forest:
    rng = random.Random(seed)
    pages = [Page(s) for s in sources]
    texts, articles, xs, ys = [], [], [], []
    for p in pages:
        if seeded(p):
            y = labels(p)
            blocks = p.text(y.tolist()).split("\n\n")
            articles.append(blocks)
            texts += blocks
            use = [n.chars > 0 for n in p.nodes]
            xs.append(np.array(p.features())[use])
            ys.append(y[use])
    if not any(texts):
        texts = ["some words of a text that stand for any other, with a comma and an end."] * 8
        articles = [texts]
    for blocks in articles * VARIANTS if len(articles) > 20 else articles * (VARIANTS * 20):
        cut = blocks[:rng.randint(1, 1 + len(blocks))]
        p = Page(training_page(rng, texts, cut))
        use = [n.chars > 0 for n in p.nodes]
        xs.append(np.array(p.features())[use])
        ys.append(labels(p)[use])
    return Forest(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def extract(sources: list[str], forest: Forest) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [p.features() for p in pages]
    z = forest.log_odds(np.array([r for x in rows for r in x]).reshape(-1, N_FEATURES))
    out, at = [], 0
    for p in pages:
        out.append(p.text(decode(p, z[at:at + len(p.nodes)])))
        at += len(p.nodes)
    return out


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    picked = (rows.select("page_id").where("page_id IS NOT NULL").distinct()
              .orderBy(F.md5(F.col("page_id").cast("string")), "page_id").limit(sample))
    sources = (rows.join(F.broadcast(picked), "page_id").where("html IS NOT NULL")
               .select("page_id", "html").dropDuplicates(["page_id"]).orderBy("page_id").collect())
    shared = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in sources]))

    def run(batches):
        forest = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                texts = extract([s or "" for s in part.column("html").to_pylist()], forest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()),
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
