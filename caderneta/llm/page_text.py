"""Main text of web pages: gradient-boosted trees over nodes of the page's tree, and a hierarchical decoding.

A node is open if some of its text belongs to the article. Trees predict this from the node's subtree density, attribute words, depth, siblings and surroundings. The decoding
finds the most likely labelling in which everything below a closed node is closed, so a menu inside an article goes and a paragraph inside a
menu can't stay. Text of open nodes is the main text.

The trees are fitted on labelled pages that a seeded generator composes of articles, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments in many forms of markup; their number is a parameter. Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caderneta.llm import dom
from caderneta.llm.common import col, short_batches

TRAINING_PAGES = 500
SEED = 7
TREES, DEPTH, RATE, BINS, LEAST_ROWS, SMOOTH = 60, 4, 0.2, 32, 20, 1.0


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth; node k has the children 2 k + 1 and 2 k + 2."""

    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += leaf[at - len(bound)]
        return total


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the log loss with histograms; splits with the largest gain, level by level."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    width = BINS + 1
    inner = (1 << DEPTH) - 1
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), start)
    features, bounds, leaves = [], [], []
    columns = np.arange(x.shape[1])
    flat = binned + columns * width
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, p * (1 - p)
        feature, bound, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low = (1 << level) - 1
            size = (1 << level) * len(columns) * width
            place = (((at - low) * len(columns) * width)[:, None] + flat).ravel()
            sums = [
                np.bincount(place, np.repeat(w, len(columns)), size).reshape(1 << level, len(columns), width).cumsum(axis=2)
                for w in (gradient, curve, np.ones(len(y)))
            ]
            (g, h, n), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = g**2 / (h + SMOOTH) + (gt - g) ** 2 / (ht - h + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(n < LEAST_ROWS) | (nt - n < LEAST_ROWS)] = 0
            best = gain.reshape(1 << level, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, cut = divmod(b, width)
                if gain[k, f, cut] > 1e-6 and cut < len(cuts[f]):
                    feature[low + k], bound[low + k] = f, cuts[f][cut]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > bound[at])
        own = at - inner
        leaf = RATE * np.bincount(own, gradient, inner + 1) / (np.bincount(own, curve, inner + 1) + SMOOTH)
        score += leaf[own]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(bounds), np.array(leaves), start)


class _Maker:
    """Random pages whose elements carry their label in ``data-y``."""

    SYLLABLES = ["ta re mi son der ein lich un est la que ción os th ing ed ou er", "на ре сто ли пра во ка ми", "ά λο γο μα τι σε ρη", "ka ri su mo né ü ß ø å"]

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        syllables = self.r.choice(self.SYLLABLES).split() if self.r.random() < 0.2 else self.SYLLABLES[0].split()
        return " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(n))

    def prose(self, least: int = 1, most: int = 60) -> str:
        out, n = [], int(self.r.triangular(least, most, least))
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            s = self.words(k).capitalize()
            if self.r.random() < 0.1:
                s = s.replace(" ", self.r.choice(["### ", "%%% ", " &amp; "]))
            if self.r.random() < 0.06:
                s = f'<a href="/x">{s}</a>'
            out.append(s + self.r.choice([".", ".", ".", "!", "?", ""]))
            n -= k
        return " ".join(out)

    def el(self, tag: str, inner: str, label: int, names: str = "", role: str = "") -> str:
        attributes = f" data-y={label}"
        if names:
            attributes += f' {self.r.choice(["class", "class", "id"])}="{names}"'
        if role and self.r.random() < 0.3:
            attributes += f' role="{role}"'
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def named(self, words: str) -> str:
        w = self.r.choice(words.split())
        return self.r.choice([w, w, f"{w}-{self.r.choice(['box', 'wrap', 'inner', 'area', 'block', '1'])}", f"site-{w}", f"page{w.capitalize()}"])

    def links(self, n: int, label: int = 0) -> str:
        items = [f'<a href="/{i}">{self.words(self.r.randint(1, 4))}</a>' for i in range(n)]
        if self.r.random() < 0.75:
            return self.el("ul", "".join(self.el("li", a, label) for a in items), label)
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def boilerplate(self, kind: str) -> str:
        r, plain = self.r, self.r.random() < 0.12
        words = dict(zip("main menu header footer side related ad notice comment form share".split(), dom.FAMILIES, strict=True))[kind]
        tag, role = {
            "menu": (["nav", "nav", "div", "ul"], "navigation"), "header": (["header", "header", "div"], "banner"),
            "footer": (["footer", "footer", "div"], "contentinfo"), "side": (["aside", "aside", "div", "section"], "complementary"),
            "related": (["div", "section", "aside"], ""), "ad": (["div", "div", "aside", "section", "p"], ""),
            "notice": (["div", "div", "section", "p", "aside"], "alert"), "comment": (["section", "div", "ol", "ul"], ""),
            "form": (["form", "form", "div"], "search"), "share": (["div", "ul", "p"], ""),
        }[kind]
        tag = r.choice(tag)
        if kind in ("menu", "share"):
            inner = self.links(r.randint(2, 9))
        elif kind == "header":
            inner = r.choice([self.el("h1", self.words(2), 0), self.el("div", self.words(2), 0, "logo"), self.words(3)]) + r.choice(["", self.links(4), self.el("p", self.prose(2, 12), 0)])
        elif kind == "footer":
            inner = r.choice(["&copy; ", "Copyright 2020 ", ""]) + self.prose(2, 25) + r.choice(["", self.links(4), self.el("p", self.prose(2, 30), 0)])
        elif kind in ("side", "related"):
            inner = self.el("h3", self.words(2), 0) + r.choice([self.links(r.randint(2, 7)), "".join(self.el("p", self.prose(3, 25), 0) for _ in range(r.randint(1, 4)))])
        elif kind == "comment":
            item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            one = lambda: self.el(item, (self.el("div", self.words(1) + " 2021", 0, "author") if item != "p" else "") + (self.el("p", self.prose(2, 50), 0) if item != "p" else self.prose(2, 50)), 0, self.named("comment reply") if r.random() < 0.7 else "")
            inner = (self.el("h3", self.words(1), 0) if item != "li" else "") + "".join(one() for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = "".join(f"<label>{self.words(1)}</label><input name=x> " for _ in range(r.randint(1, 3))) + self.el("button", self.words(1), 0)
            inner = r.choice(["", self.el("p", self.prose(2, 15), 0)]) + inner
        else:
            inner = r.choice([self.prose(2, 40), self.el("p", self.prose(2, 40), 0) if tag != "p" else self.prose(2, 20)])
            inner += self.el("button", self.words(1), 0) if kind == "notice" and r.random() < 0.5 and tag != "p" else ""
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        return self.el(tag, inner, 0, "" if plain and semantic or semantic and r.random() < 0.5 else self.named(words), role)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(self.el("h1", self.words(r.randint(1, 9)), 1))
        for _ in range(int(r.triangular(1, 18, 3))):
            k = r.random()
            if k < 0.72:
                tag = "div" if r.random() < 0.07 else "p"
                text = self.prose(1, 90)
                parts.append(self.el(tag, r.choice([text, text, f"<b>{text}", f"{text}<br>{self.prose()}"]), 1, self.named("text lead intro paragraph") if r.random() < 0.1 else ""))
            elif k < 0.80:
                parts.append(self.el(r.choice(["h2", "h3"]), self.words(r.randint(1, 7)), 1))
            elif k < 0.86:
                parts.append(self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.prose(1, 20), 1) for _ in range(r.randint(1, 6))), 1))
            elif k < 0.90:
                parts.append(self.el("blockquote", r.choice([self.prose(2, 40), self.el("p", self.prose(2, 40), 1)]), 1))
            elif k < 0.93:
                row = lambda: self.el("tr", "".join(self.el("td", self.words(r.randint(1, 4)), 1) for _ in range(3)), 1)
                parts.append(self.el("table", "".join(row() for _ in range(r.randint(1, 5))), 1))
            elif k < 0.95:
                parts.append(self.el("figure", self.el("figcaption", self.prose(2, 12), 1), 1))
            else:
                parts.append(self.boilerplate(r.choice("ad related share notice form side menu".split())))
        if r.random() < 0.15:
            parts.append(self.boilerplate(r.choice(["comment", "share", "related", "footer", "header"])))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        body = self.article()
        holder = r.random()
        if holder < 0.5:
            body = self.el("article", body, 1, self.named(dom.FAMILIES[0]) if r.random() < 0.4 else "")
        elif holder < 0.9:
            body = self.el(r.choice(["div", "div", "section", "main"]), body, 1, self.named(dom.FAMILIES[0]))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            side = self.boilerplate(r.choice(["side", "comment", "ad", "related"])) if r.random() < 0.5 else ""
            front = self.boilerplate(r.choice(["menu", "notice", "ad", "side"])) if r.random() < 0.3 else ""
            body = self.el(r.choice(["div", "main", "section", "div"]), front + body + side, 1, r.choice(["", self.named("container wrapper layout row main content page")]))
        top = "".join(self.boilerplate(k) for k in ("notice", "header", "menu", "ad", "form") if r.random() < 0.45)
        end = "".join(self.boilerplate(k) for k in ("comment", "related", "side", "share", "form", "ad", "notice", "menu", "footer") if r.random() < 0.33)
        return f"<html><head><title>{self.words(4)}</title></head><body data-y=1>{top}{body}{end}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


@cache
def fit(pages: int = TRAINING_PAGES, seed: int = SEED) -> Forest:
    """Trees for the node labels of generated pages. The same arguments give the same trees."""
    rows, labels = [], []
    for html in labelled_pages(pages, seed):
        page = dom.Page(html, labelled=True)
        found = [page.label[i] if page.label[i] is not None else page.label[p] if p >= 0 else True for i, p in enumerate(page.parent)]
        known = [i for i, y in enumerate(found) if y is not None]
        rows.append(dom.features(page)[known])
        labels += [found[i] for i in known]
    return fit_forest(np.concatenate(rows), np.array(labels, np.float64))


def open_nodes(parent: list[int], logits: np.ndarray) -> list[bool]:
    """The most likely labelling in which no node is open below a closed one. ``logits`` are log odds of being open."""
    n = len(parent)
    yes = (-np.logaddexp(0, -logits)).tolist()
    no = (-np.logaddexp(0, logits)).tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        yes[p] += max(yes[i], no[i])
        no[p] += no[i]
    out = [True] * n
    for i in range(n):
        out[i] = (i == 0 or out[parent[i]]) and yes[i] >= no[i]
    return out


def _texts(forest: Forest, pages: list[str]) -> list[str]:
    trees = [dom.Page(p) for p in pages]
    tables = [dom.features(t) for t in trees]
    logits = np.split(forest.logits(np.concatenate(tables)), np.cumsum([len(t) for t in tables])[:-1]) if pages else []
    out = []
    for tree, own in zip(trees, logits, strict=True):
        opened = open_nodes(tree.parent, own)
        out.append(" ".join(text for element, text, _ in tree.runs if opened[element]))
    return out


def main_text(html: str, forest: Forest | None = None) -> str:
    """Main text of one page."""
    return _texts(forest or fit(), [html])[0]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", forest: Forest | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the whole main text and its code points.

    Blocks are joined in page order by one space, white space in a block is one space. A null or empty page has an empty text. Repeated rows stay.
    """
    short_batches(pages.sparkSession, 256)
    trees = forest or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(trees, [p or "" for p in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(col(page_id).cast("long"), col(url), col(html))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
