"""A small tree of block elements of an HTML page, with the text runs in them and features of its nodes."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Sections without an end run to the end of the page.
UNCLOSED = [("<!--", "-->"), ("<![CDATA[", "]]>")]
_LABEL = re.compile(r"data-y=\"?([01])")

# Fixed values of HTML: elements without content, with raw content, and that stand in a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg canvas textarea select title audio video head".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var".split()
)
# Formulas stand in a line of text; annotations repeat a formula in another notation and aren't shown.
INLINE |= set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
RAW |= {"annotation", "annotation-xml"}
# What an element's start closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

TAG_GROUPS = [
    {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "button", "legend"}, {"article", "main"},
    {"section", "div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "thead", "tbody", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"#run"}, {"body", "html"},
]
# Words of id, class, role and label attributes, by what they tell.
FAMILIES = [
    "article content main post story entry body text prose",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs links",
    "header masthead banner topbar branding logo",
    "footer bottom copyright colophon legal contentinfo",
    "sidebar side aside rail widget complementary",
    "related recommended trending popular more",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "cookie cookies consent gdpr notice notification alert popup modal overlay dialog disclaimer paywall alertdialog",
    "comment comments reply replies discussion respond response responses thread reader",
    "form search login signup subscribe newsletter subscription register contact",
    "share sharing social follow",
]
_FAMILY = {w: 1 << i for i, words in enumerate(FAMILIES) for w in words.split()}
_GROUP = {t: i for i, tags in enumerate(TAG_GROUPS) for t in tags}
N_TAGS, N_FAMILIES = len(TAG_GROUPS), len(FAMILIES)
ANCESTOR_TAGS = 6  # the first groups also count for what stands inside


@lru_cache(8192)
def _families(attributes: str) -> int:
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("id", "class", "role", "aria-label", "itemprop"):
            for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
                found |= _FAMILY.get(w.lower(), 0)
    return found


@lru_cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}", re.IGNORECASE | re.ASCII)


class Page:
    """Elements in page order (parents first): tag, parent, families, label; and runs: element, text, characters in links."""

    def __init__(self, html: str, labelled: bool = False):
        """``labelled`` pages are made for training and mark their elements with ``data-y``."""
        self.tag, self.parent, self.families, self.label = ["html"], [-1], [0], [None]
        self.runs: list[tuple[int, str, int]] = []
        stack, pieces, linked, in_link = [0], [], 0, 0
        opened = Counter()  # names on the stack, but for the root
        endless: set[str] = set()  # raw elements that nothing ends any more
        at = 0
        # Behind the last bracket no tag can end, only a comment can begin; looking for one there would read the rest again and again.
        tail = html.rfind(">") + 1
        cut = html.find("<!--", tail)
        html = html[:cut] if cut >= 0 else html

        def flush() -> None:
            nonlocal pieces, linked
            text = " ".join("".join(pieces).split())
            if text:
                self.runs.append((stack[-1], text, linked))
            pieces, linked = [], 0

        def close(down_to: int) -> None:
            for i in stack[down_to:]:
                opened[self.tag[i]] -= 1
            del stack[down_to:]

        for m in _TOKEN.finditer(html, 0, tail):
            begin, end = m.span()
            if begin < at:
                continue  # inside raw content
            if begin > at:
                text = html[at:begin]
                text = unescape(text) if "&" in text else text
                pieces.append(text)
                if in_link:
                    linked += len(text)
            at = end
            name = m[2] or m[5]
            if name is None:
                if any(m[0].startswith(a) and not m[0].endswith(b) for a, b in UNCLOSED):
                    at = len(html)
                continue
            name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
            elif name == "br":
                pieces.append(" ")
            elif closing:
                flush()
                if opened[name]:
                    last = len(stack) - 1
                    while self.tag[stack[last]] != name:
                        last -= 1
                    close(last)
            elif name in RAW:
                if name != "head" and not attributes.endswith("/"):
                    stop = None if name in endless else _end_tag(name).search(html, end)
                    if not stop:
                        endless.add(name)
                    if stop:
                        at = html.find(">", stop.start()) + 1 or len(html)
                    elif name in ("script", "style"):
                        at = len(html)
            elif name in VOID:
                if name == "hr":
                    flush()
            elif name == "html":
                continue
            else:
                flush()
                in_link = 0
                while self.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
                closes, scope = CLOSES.get(name, ((), ()))
                if any(opened[c] for c in closes):
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] in scope:
                            break
                        if self.tag[stack[i]] in closes:
                            close(i)
                            break
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.families.append(_families(attributes) if attributes else 0)
                mark = _LABEL.search(attributes) if labelled else None
                self.label.append(mark[1] == "1" if mark else None)
                stack.append(len(self.tag) - 1)
                opened[name] += 1
        if at < len(html):
            pieces.append(unescape(html[at:]))
        flush()
        self._name_runs()

    def _name_runs(self) -> None:
        """Runs beside child elements become nodes of their own."""
        parents = set(self.parent)
        for i, (element, text, linked) in enumerate(self.runs):
            if element in parents:
                self.tag.append("#run")
                self.parent.append(element)
                self.families.append(0)
                self.label.append(None)
                self.runs[i] = (len(self.tag) - 1, text, linked)


def features(page: Page) -> np.ndarray:
    """A row for each node: density and size of its subtree, its place, its siblings, and tags and attribute words on the way to it."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 6))  # characters, words, characters in links, sentence ends, runs, nodes
    own[:, 5] = 1
    first = np.full(n, 1e9)
    at = 0
    for element, text, linked in page.runs:
        own[element] += (len(text), text.count(" ") + 1, min(linked, len(text)), text.count(".") + text.count("!") + text.count("?"), 1, 0)
        first[element] = min(first[element], at)
        at += len(text)
    sums = own.copy()
    depth = np.zeros(n)
    order = range(n - 1, 0, -1)
    # Runs stand after their elements' children, so parents always come before.
    for i in order:
        sums[parent[i]] += sums[i]
        first[parent[i]] = min(first[parent[i]], first[i])
    inside_tags, inside_words = [0] * n, [0] * n
    group = [_GROUP.get(t, 6) for t in page.tag]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        p = page.parent[i]
        mark = 1 << group[i] if group[i] < ANCESTOR_TAGS else 0
        if p >= 0:
            kids[p].append(i)
            depth[i] = depth[p] + 1
            inside_tags[i] = inside_tags[p] | mark
            inside_words[i] = inside_words[p] | page.families[i]
        else:
            inside_tags[i], inside_words[i] = mark, page.families[i]
    index, count, alike, before, after, near = (np.zeros(n) for _ in range(6))
    for members in kids:
        m = len(members)
        for k, i in enumerate(members):
            index[i], count[i] = k / m, m
            before[i] = sums[members[k - 1], 0] if k else 0
            after[i] = sums[members[k + 1], 0] if k + 1 < m else 0
        if m > 1:
            groups = Counter(group[i] for i in members)
            total = sum(sums[i, 0] for i in members)
            for i in members:
                alike[i] = groups[group[i]] / m
                near[i] = (total - sums[i, 0]) / (m - 1)
    chars = np.maximum(sums[:, 0], 1)
    up = np.maximum(parent, 0)
    links = sums[:, 2] / chars
    tags = np.array(group)[:, None] == np.arange(N_TAGS)
    bits = lambda x, k: (np.array(x)[:, None] >> np.arange(k)) & 1
    numbers = np.column_stack([
        np.log1p(sums[:, 0]), np.log1p(sums[:, 1]), links, sums[:, 3] / np.maximum(sums[:, 1], 1), sums[:, 1] / np.maximum(sums[:, 4], 1),
        np.log1p(sums[:, 5]), sums[:, 0] / max(sums[0, 0], 1), np.minimum(first, at) / max(at, 1), depth, index, np.log1p(count), alike,
        np.log1p(before), np.log1p(after), np.log1p(near), links[up], sums[:, 0] / chars[up], np.log1p(own[:, 0]), sums[:, 3] > 0,
    ])
    return np.hstack([
        numbers, tags, bits(inside_tags, ANCESTOR_TAGS), bits(page.families, N_FAMILIES), bits(inside_words, N_FAMILIES)
    ]).astype(np.float32)
