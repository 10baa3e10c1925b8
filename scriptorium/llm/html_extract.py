"""Main text of web pages: boosted trees over the nodes of the document tree, decoded from the root down.

A page is parsed to a tree of its block elements, and of what else carries a class, id or role.  Each node is described by
its tag and attribute words, its depth, the text, link and tag counts of its subtree, and how it compares with its
siblings.  Gradient-boosted trees give the chance that a node holds main text, given that its parent does.  The decoder then
chooses main or not for all nodes together, the likeliest choice in which nothing below a node that is not main is main.

The trees are learned when first needed, from pages that ``training_page`` makes up (PAGES of them, by a fixed seed), whose
labels are known; nothing is learned from the pages to be read.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import prepare

# Element names of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # without an end tag, the rest of the page
MUTE = frozenset("noscript template svg select button object audio video canvas".split())  # elements that are never main
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption header footer nav aside form fieldset address details summary menu hr center dialog search hgroup legend".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd thead tbody tfoot tr td th caption legend summary figcaption".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span sup sub mark abbr cite q label time kbd samp var del ins dfn bdi bdo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption legend summary address".split())
# Words of class, id and role attributes, by what they speak for.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar skip tabs topbar masthead banner header hdr head logo",
    "edge": "footer foot ftr sidebar side rail widget colophon copyright legal bottom complementary contentinfo",
    "offer": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login register form search paywall disclaimer",
    "talk": "comment comments commentlist reply replies respond disqus feedback share sharing social follow related recommended recommendations byline discussion reviews reader readers",
    "main": "article content main post entry story prose richtext pullquote blockquote callout inset lead abstract",
    "everyday": "more also popular trending tags meta review message warning announcement note info aside text body page single blog news document copy box highlight summary",
}
_WORD_GROUP = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
_GROUPS = len(WORDS)
_TAG_GROUP = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "fieldset": 4, "dialog": 4, "search": 4, "article": 5, "main": 5, "p": 6, "blockquote": 6, "pre": 6, "h1": 11, "h2": 7, "h3": 7, "h4": 7, "h5": 7, "h6": 7, "hgroup": 7, "ul": 8, "ol": 8, "li": 8, "dl": 8, "dt": 8, "dd": 8, "table": 9, "tbody": 9, "thead": 9, "tfoot": 9, "tr": 9, "td": 9, "th": 9, "figure": 9, "#text": 10}
_TAGS = 13

_TAG = re.compile(r"""<(?:!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_TELLING = frozenset({"class", "id", "role", "data-main"})
_MUTE_TAG = re.compile(rf"<(?:{'|'.join(sorted(MUTE))})[\s/>]", re.IGNORECASE)
_HEAD_END = re.compile(r"</head[\s/>]|<body[\s/>]|<(?:article|main|div|p|nav|header|section)[\s>]", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(attributes: str) -> list[tuple[str, str]]:
    """(name, value) of the telling attributes of a tag."""
    return [(n, a or b or c) for n, a, b, c in ((x[0].lower(), *x[1:]) for x in _ATTRIBUTE.findall(attributes)) if n in _TELLING]


@functools.lru_cache(20_000)
def _described(attributes: str) -> tuple[tuple[int, ...], bool]:
    """(how many words of each group a tag's attributes hold, whether it is labelled main)."""
    counts, main = [0] * _GROUPS, False
    for name, value in _named(attributes):
        if name == "data-main":
            main = True
            continue
        for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
            k = _WORD_GROUP.get(w)
            if k is not None:
                counts[k] += 1
    return tuple(counts), main


def _raw_end(source: str, name: str, at: int) -> int:
    """Where a raw-text element's content and end tag are over."""
    stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
    return source.find(">", stop.end() - 1) + 1 or len(source) if stop else len(source)


def _muted(source: str) -> dict[int, int]:
    """Where each element of MUTE ends, by the end of its start tag.

    It ends with its end tag.  One that has none before an element around it ends (or, of buttons and selects, before the
    next one starts) reaches to the first block's tag after it.
    """
    out: dict[int, int] = {}
    stack: list[list] = []  # [name, the end of its start tag, the first block's tag inside]; of blocks the name alone counts
    names: Counter[str] = Counter()
    mute: list[list] = []  # those of the stack that are of MUTE

    def pop_to(name: str, end: int | None, here: int) -> None:
        """Takes elements off the stack down to the last one of this name, which has its end tag up to end; others stop here."""
        while stack:
            last = stack.pop()
            names[last[0]] -= 1
            found = last[0] == name
            if last[0] in MUTE:
                mute.pop()
                if found and end is not None:
                    out[last[1]] = end
                else:
                    out[last[1]] = here if last[2] is None else last[2]
                    if mute and mute[-1][2] is None:
                        mute[-1][2] = last[2]
            if found:
                return

    at = 0
    while m := _TAG.search(source, at):
        at = m.end()
        end, start, attributes = m.groups()
        name = (end or start or "").lower()
        if name in RAW and start is not None:
            at = at if attributes.endswith("/") else _raw_end(source, name, at)
            continue
        if name in BLOCK and mute and mute[-1][2] is None:
            mute[-1][2] = m.start()
        if end is not None:
            if names[name]:
                pop_to(name, at, m.start())
        elif name in MUTE and not attributes.endswith("/"):
            if name in ("button", "select") and names[name]:
                pop_to(name, None, m.start())
            stack.append([name, at, None])
            mute.append(stack[-1])
            names[name] += 1
        elif name in BLOCK and name not in VOID:
            stack.append([name, at, None])
            names[name] += 1
    pop_to("", None, len(source))
    return out


class Page:
    """The nodes of a page in document order, each after its parent, and its text runs.

    runs: (node, raw text, inside a link) in order; None marks where a block begins or ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str, bool] | None] = []
        # Open elements: (name, the node that each belongs to, the depth of the p that a block here would end, or 0).
        stack: list[tuple[str, int, int]] = [("#root", 0, 0)]
        links = at = 0
        muted = _muted(source) if _MUTE_TAG.search(source) else {}
        add = self.runs.append
        places: dict[str, list[int]] = {}  # depths of the open elements by name, headings as one; and of all blocks
        blocks: list[int] = [0]
        headless = False

        def open_at(name: str) -> int:
            """The depth of the innermost open element of a name; 0 for none."""
            found = places.get("h" if name in HEADINGS else name)
            return found[-1] if found else 0

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                name = stack.pop()[0]
                places["h" if name in HEADINGS else name].pop()
                if name == "a":
                    links -= 1
                if name in BLOCK:
                    blocks.pop()
                    add(None)

        while m := _TAG.search(source, at):
            if m.start() > at:
                add((stack[-1][1], source[at : m.start()], links > 0))
            at = m.end()
            end, start, attributes = m.groups()
            if end is not None:
                name = end.lower()
                if name == "br":
                    add((stack[-1][1], " ", False))
                    continue
                # An inline element ends only inside the block that it began in.
                if (depth := open_at(name)) and (name in BLOCK or depth > blocks[-1]):
                    close(depth)
            elif start is not None:
                name = start.lower()
                if name == "br":
                    add((stack[-1][1], " ", False))
                    continue
                if name in CLOSES_P and stack[-1][2]:
                    close(stack[-1][2])
                if name in _SAME:
                    # The outermost of those that this one ends, inside the list or table that it is in.
                    scope = max(map(open_at, _SCOPE[name]))
                    inside = (places.get(x, []) for x in _SAME[name])
                    found = [d[k] for d in inside if (k := bisect.bisect_right(d, scope)) < len(d)]
                    if found:
                        close(min(found))
                if name in MUTE:
                    at = muted.get(at, at)
                    add((stack[-1][1], " ", False))
                    continue
                if name in RAW or name == "head":
                    if name == "head":
                        stop = None if headless else _HEAD_END.search(source, at)
                        if stop is None:
                            headless = True
                            if not attributes.endswith("/"):
                                at = len(source)
                        elif not stop[0].startswith("</"):
                            at = stop.start()
                        else:
                            at = source.find(">", stop.end() - 1) + 1 or len(source)
                    elif not attributes.endswith("/"):
                        at = _raw_end(source, name, at)
                    if name not in ("head", "title", "script", "style"):
                        add((stack[-1][1], " ", False))
                    continue
                if name == "a" and open_at("a") > blocks[-1]:
                    close(open_at("a"))
                block = name in BLOCK
                if block:
                    add(None)
                if name in VOID or attributes.endswith("/") and not block:
                    continue
                node = stack[-1][1]
                if block or attributes and _named(attributes):
                    node = len(self.tag)
                    self.tag.append(name)
                    self.parent.append(stack[-1][1])
                    self.attributes.append(attributes)
                depth = len(stack)
                stack.append((name, node, depth if name == "p" else stack[-1][2] if name in FORMATTING else 0))
                places.setdefault("h" if name in HEADINGS else name, []).append(depth)
                if block:
                    blocks.append(depth)
                links += name == "a"
        if at < len(source):
            add((stack[-1][1], source[at:], links > 0))
        self._own_runs()

    def _own_runs(self) -> None:
        """Gives each text that stands directly in a container a node of its own."""
        held = 0
        for k, run in enumerate(self.runs):
            if run is None:
                held = 0
            elif self.tag[run[0]] not in _LEAF and self.tag[run[0]] in BLOCK and not run[1].isspace():
                if not held or self.parent[held] != run[0]:
                    held = len(self.tag)
                    self.tag.append("#text")
                    self.parent.append(run[0])
                    self.attributes.append("")
                self.runs[k] = (held, run[1], run[2])

    def features(self) -> tuple[np.ndarray, list[bool]]:
        """(a row for each node, whether each is labelled main)."""
        n = len(self.tag)
        chars, linked, words, stops, tags, paragraphs, depth = ([0] * n for _ in range(7))
        marks = [0] * n
        for run in self.runs:
            if run is None:
                continue
            node, text, link = run
            size = len(text) - text.count(" ") if not text.isspace() else 0
            if not size:
                continue
            chars[node] += size
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            marks[node] += ("©" in text) + ("&copy" in text)
            if link:
                linked[node] += size
        own = list(chars)
        main = [False] * n
        described = [_described(a) if a else ((0,) * _GROUPS, False) for a in self.attributes]
        children: list[list[int]] = [[] for _ in range(n)]
        inside = [0] * n
        for k in range(1, n):
            p = self.parent[k]
            depth[k] = depth[p] + 1
            main[k] = main[p] or described[k][1]
            inside[k] = inside[p] or (_TAG_GROUP.get(self.tag[k]) == 5) or described[k][0][4] > 0
            children[p].append(k)
        for k in sorted(range(1, n), key=depth.__getitem__, reverse=True):
            p = self.parent[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
            words[p] += words[k]
            stops[p] += stops[k]
            marks[p] += marks[k]
            tags[p] += tags[k] + 1
            paragraphs[p] += paragraphs[k] + (self.tag[k] == "p")
            main[p] = main[p] or main[k]
        total = chars[0] or 1
        rows = np.zeros((n, len(FEATURES)), np.float32)
        for p in range(n):
            brood = children[p]
            if not brood:
                continue
            sizes = [chars[c] for c in brood]
            most, whole, cards = max(sizes), sum(sizes) or 1, len(brood)
            links = sum(linked[c] for c in brood)
            kinds = [self.tag[c] for c in brood]
            alike = Counter(kinds)
            for at, c in enumerate(brood):
                size, tag = chars[c], kinds[at]
                others = cards - 1 or 1
                row = [0.0] * _TAGS
                row[_TAG_GROUP.get(tag, 12)] = 1.0
                before, after = (brood[at - 1] if at else c), (brood[at + 1] if at + 1 < cards else c)
                rows[c] = [
                    *row,
                    *described[c][0],
                    *described[p][0],
                    depth[c],
                    math.log1p(size),
                    math.log1p(words[c]),
                    linked[c] / (size or 1),
                    math.log1p(tags[c]),
                    size / (tags[c] + 1),
                    stops[c] / (words[c] or 1),
                    own[c] / (size or 1),
                    paragraphs[c],
                    marks[c],
                    size / total,
                    size / whole,
                    size / (most or 1),
                    cards,
                    at / others,
                    alike[tag],
                    (whole - size) / others,
                    (links - linked[c]) / ((whole - size) or 1),
                    chars[before],
                    chars[after],
                    1.0 if inside[p] else 0.0,
                ]
        return rows, main

    def text(self, kept: list[bool]) -> str:
        """The text of the kept nodes: a space between blocks, white space made one."""
        out: list[str] = []
        for run in self.runs:
            if run is None:
                out.append(" ")
            elif kept[run[0]]:
                out.append(html.unescape(run[1]) if "&" in run[1] else run[1])
        return " ".join("".join(out).split())


FEATURES = [*(f"tag_{k}" for k in range(_TAGS)), *(f"word_{w}" for w in WORDS), *(f"parent_{w}" for w in WORDS), *"depth chars words link_density tags text_density stop_density own_share paragraphs marks page_share parent_share largest_share siblings place same_tags other_chars other_links before after inside".split()]


class Boosted:
    """Gradient-boosted trees of fixed depth for a yes or no, by histograms of at most 32 bins."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.25, bins: int = 32, smooth: float = 20.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64)
        chance = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(chance / (1 - chance))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf, np.float32)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                best = np.full(width, 1e-9)
                cuts = [(0, -1)] * width
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = local * self.bins + binned[f]
                    gs = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + self.smooth) + (gt - gs) ** 2 / (ht - hs + self.smooth) - gt**2 / (ht + self.smooth))[:, : len(e)]
                    top = gain.argmax(1)
                    for w in np.flatnonzero(gain[np.arange(width), top] > best):
                        best[w], cuts[w] = gain[w, top[w]], (f, int(top[w]))
                for w, (f, c) in enumerate(cuts):
                    if c >= 0:
                        feature[first + w], threshold[first + w] = f, edges[f][c]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.smooth)
            score += value[leaf]
            self.trees.append((feature, threshold, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - (2**self.depth - 1)]
        return score


def decode(page: Page, log_odds: list[float]) -> list[bool]:
    """Which nodes are main: the likeliest choice for all of them, a node below one that is not main not being main.

    log_odds are those of a node whose parent is main; below a node that isn't, nothing is left to choose.
    """
    n = len(page.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[page.parent[k]].append(k)
    order = [0]
    for k in order:
        order += children[k]
    below = [0.0] * n  # the log chance of the best choice below a node that is main
    kept = [True] * n
    for k in reversed(order[1:]):
        odds = min(30.0, max(-30.0, log_odds[k]))
        yes, no = below[k] - math.log1p(math.exp(-odds)), -math.log1p(math.exp(odds))
        kept[k] = yes > no
        below[page.parent[k]] += max(yes, no)
    for k in order[1:]:
        kept[k] = kept[k] and kept[page.parent[k]]
    return kept


# ---- pages made up for learning

PAGES, SEED = 2000, 20240101
_SYLLABLES = "an er th in on re ed ti es or en at nd st ou he sh ly ing ble qu ma lo si du va ri pe no cha ment eau sch ung keit ción ar las é ü ñ ô".split()


#: Words that boxes of a story are named by as well as others.
_PLAIN = [*WORDS["everyday"].split(), "chapter", "part", "section", "intro", "step", "main"]


class _Maker:
    """Makes up pages; elements of the main text carry data-main, which is no feature."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def maybe(self, chance: float) -> bool:
        return self.r.random() < chance

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        if len(words) > 6 and self.maybe(0.6):
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, most: int = 8) -> str:
        out = " ".join(self.sentence(1 if self.maybe(0.1) else 3) for _ in range(self.r.randint(1, most)))
        if self.maybe(0.15):
            out = out.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.maybe(0.15):
            out = f"<b>{out[:20]}</b>{out[20:]}"
        if self.maybe(0.1):
            out += f"<br>{self.sentence()}"
        return out

    def links(self, n: int) -> str:
        """Entries of a list of links; some lists end their entries with stops, as sentences and headlines do."""
        stops = self.maybe(0.3)
        text = lambda: " ".join(self.word() for _ in range(self.r.randint(1, 4))) + (self.r.choice(["", "", ".", ",", "!", "?"]) if stops else "")
        return "".join(f'<li><a href="/{self.word()}">{self.sentence() if self.maybe(0.05) else text()}</a></li>' for _ in range(n))

    def name(self, group: str) -> str:
        """An attribute that speaks for a group, or for nothing."""
        if self.maybe(0.06):
            return self.r.choice(["", f' class="{self.word()[:2]}{self.r.randint(1, 99)}"', ' class="row"', ' class="container wrap"', ' id="block"'])
        word = self.r.choice(WORDS["everyday" if group != "menu" and self.maybe(0.15) else group].split())
        word = self.r.choice([word, f"{word}-{self.r.choice(['box', 'wrap', 'inner', 'area', 'list'])}", f"site-{word}", f"{word}{self.r.randint(1, 9)}"])
        return f' {self.r.choice(["class", "class", "id"])}="{word}"'

    def block(self, tags: list[str], group: str, inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.name(group) if tag in ('div', 'section', 'ul', 'p', 'span') or self.maybe(0.5) else ''}>{inner}</{tag}>"

    def menu(self) -> str:
        return self.block(["nav", "nav", "div", "header"], "menu", f"<ul>{self.links(self.r.randint(2, 14))}</ul>")

    def top(self) -> str:
        return self.block(["header", "div"], "menu", f"<h2>{self.word()}</h2>" + (f"<p>{self.sentence(2, 8)}</p>" if self.maybe(0.5) else "") + (self.menu() if self.maybe(0.4) else ""))

    def offer(self) -> str:
        inner = self.r.choice([self.sentence(), self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.prose(3)}</p>", f'{self.sentence()} <a href="/{self.word()}">{self.word()}</a>', f"<h3>{self.sentence(2, 5)}</h3><p>{self.sentence()}</p>"])
        if self.maybe(0.1):
            return f'<p class="{self.r.choice(WORDS["offer"].split())}">{self.sentence()}</p>'
        return self.block(["div", "div", "div", "aside", "section"], "offer", inner)

    def form(self) -> str:
        return f"<form{self.name('offer') if self.maybe(0.5) else ''}><label>{self.word()}</label><input name=a>{'<p>' + self.sentence() + '</p>' if self.maybe(0.5) else ''}<button>{self.word()}</button></form>"

    def side(self) -> str:
        parts = [self.r.choice([f"<h3>{self.sentence(1, 4)}</h3><ul>{self.links(self.r.randint(2, 8))}</ul>", f"<h4>{self.word()}</h4><p>{self.prose(3)}</p>", self.offer(), self.form()]) for _ in range(self.r.randint(1, 4))]
        return self.block(["aside", "aside", "div", "section"], "edge", "".join(parts))

    def bottom(self) -> str:
        mark = self.r.choice(["&copy; ", "© ", "", f"{self.word()}.example.com &middot; "])
        inner = self.r.choice([f"{mark}{self.word()} &middot; {self.prose(2)}", f"<p>{mark}{self.sentence()}</p>", f"<ul>{self.links(4)}</ul><p>{mark}{self.prose(3)}</p>", f"<div>{mark}{self.word()} {self.sentence()}</div>"])
        return self.block(["footer", "footer", "footer", "div"], "edge", inner)

    def talk(self) -> str:
        tag = self.r.choice(["div", "li", "article", "p", "section"])
        each = [f"<{tag}{self.name('talk') if self.maybe(0.7) else ''}>" + (f"<b>{self.word()}</b> " if self.maybe(0.6) else "") + (f"<p>{self.prose(4)}</p>" if tag != "p" else self.prose(4)) + f"</{tag}>" for _ in range(self.r.randint(1, 8))]
        title = f"<h3>{self.word()}</h3>" if self.maybe(0.6) else ""
        word = self.r.choice(["comments", "comment-list", "reader-comments", "discussion", "replies", "respond", "disqus", "reviews"])
        return f'<{(outer := self.r.choice(["section", "div", "div", "ol" if tag == "li" else "div", "aside"]))} {self.r.choice(["class", "id"])}="{word}">{title}{"".join(each)}</{outer}>'

    def related(self) -> str:
        return self.block(["div", "aside", "section"], "talk", f"<h3>{self.word()}</h3><ul>{self.links(self.r.randint(2, 7))}</ul>" if self.maybe(0.7) else " ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(4)))

    def inset(self, mark: str) -> str:
        """A part of the main text that stands out, named by an everyday word or one for such parts."""
        word = self.r.choice([*WORDS["everyday"].split(), *"pullquote callout inset lead abstract blockquote".split()])
        tag = self.r.choice(["p", "p", "div", "section", "aside", "blockquote"])
        inner = self.prose(3) if tag == "p" or self.maybe(0.3) else "".join(f"<p>{self.prose(4)}</p>" for _ in range(self.r.randint(1, 3)))
        return f'<{tag} class="{word}"{mark}>{inner}</{tag}>'

    def box(self, parts: list[str]) -> str:
        """A container of a story's parts, without a name more often than not; what of it is main its parts say."""
        kind = self.r.random()
        word = self.r.choice(_PLAIN) if kind < 0.25 else self.r.choice(WORDS["main"].split()) if kind < 0.4 else ""
        name = f' {self.r.choice(["class", "class", "id"])}="{word}{self.r.choice(["", "", "-text", "-1", " wide"])}"' if word else self.r.choice(["", "", "", "", f' class="{self.word()[:2]}{self.r.randint(1, 99)}"', ' class="row"'])
        tag, inner = self.r.choice(["section", "div", "div"]), "".join(parts)
        if self.maybe(0.05):
            return f"<details data-main=1{name}><summary>{self.sentence(1, 6)}</summary>{inner}</details>"
        return f"<{tag}{name}>{inner}</{tag}>"

    def boxed(self, parts: list[str]) -> list[str]:
        """A story's parts as pages build them: bare, as a lead and a body, with a box at the end, or in boxes throughout."""
        kind, n = self.r.random(), len(parts)
        if kind < 0.4 or n < 2:
            return [self.box(parts)] if n < 2 and kind < 0.2 else parts
        if kind < 0.6:
            cut = self.r.randint(1, n - 1) if kind < 0.5 else n - self.r.randint(1, min(3, n - 1))
            return [*parts[:cut], self.box(parts[cut:])]
        out, bare, heads, deep = [], self.maybe(0.3), self.r.choice(["", "h2", "h3"]), self.maybe(0.25)
        while parts:
            size = self.r.randint(1, 4)
            some, parts = parts[:size], parts[size:]
            if heads and self.maybe(0.9):
                some.insert(0, f"<{heads} data-main=1>{self.sentence(1, 7)}</{heads}>")
            inner = self.box(some)
            out += some if bare and self.maybe(0.4) else [self.box([inner]) if deep and self.maybe(0.5) else inner]
        if deep and self.maybe(0.4):
            out = [self.box(out)]
        return out

    def main(self) -> str:
        mark, short = " data-main=1", self.maybe(0.4)
        parts = []
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20, 30])):
            kind = self.r.random()
            if kind < 0.76:
                parts.append(f"<p{mark}>{self.sentence(1, 8) if short else self.prose(self.r.choice([1, 2, 8, 8, 14]))}</p>")
            elif kind < 0.83:
                parts.append(f"<h{(n := self.r.randint(2, 4))}{mark}>{self.sentence(1, 7)}</h{n}>")
            elif kind < 0.9:
                parts.append(f"<{(t := self.r.choice(['ul', 'ol']))}{mark}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 6))) + f"</{t}>")
            elif kind < 0.93:
                parts.append(f"<blockquote{mark}>{self.r.choice(['', '<p>'])}{self.prose(3)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table{mark}><tr><th>{self.word()}</th><th>{self.word()}</th></tr><tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr></table>")
            elif kind < 0.955:
                parts.append(f"<div{mark}>{self.prose()}</div>")
            elif kind < 0.98:
                parts.append(self.inset(mark))
            else:
                parts.append(f"<pre{mark}>{self.sentence()}\n{self.sentence()}</pre>")
        if self.maybe(0.4):
            for _ in range(self.r.randint(1, 2)):
                parts.insert(self.r.randrange(len(parts) + 1), self.r.choice([self.offer, self.related, self.form, self.offer])())
        parts = self.boxed(parts)
        if self.maybe(0.25):
            parts.append(self.r.choice([self.related, self.side, self.menu])())
        talk = self.maybe(0.35)
        if talk and self.maybe(0.5):
            parts.append(self.talk())
            talk = False
        title = f"<h1{mark}>{self.sentence(1, 10)}</h1>" if self.maybe(0.85) else ""
        if title and self.maybe(0.25):
            title = f"<header>{title}</header>"
        inner = title + "".join(parts)
        if self.maybe(0.2):
            inner = f"<div>{inner}</div>"
        out = self.block(["article", "article", "article", "main", "div", "section"], "main", inner)
        if talk:
            out += self.talk()
        if self.maybe(0.35):
            out = self.block(["main", "div", "section"], "main", out + (self.side() if self.maybe(0.4) else ""))
        return out

    def page(self) -> str:
        before = [f() for f, c in ((self.offer, 0.25), (self.top, 0.4), (self.menu, 0.7), (self.offer, 0.45), (self.side, 0.15)) if self.maybe(c)]
        after = [f() for f, c in ((self.side, 0.3), (self.related, 0.2), (self.form, 0.15), (self.offer, 0.25), (self.bottom, 0.85), (self.offer, 0.1)) if self.maybe(c)]
        if self.maybe(0.2):
            self.r.shuffle(before)
        inner = "".join([*before, self.main(), *after])
        if self.maybe(0.25):
            inner = f'<div{self.r.choice(["", " id=page", " class=wrapper", " class=container"])}>{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body>{inner}</body></html>"


def training_page(seed: int) -> str:
    return _Maker(seed).page()


@functools.lru_cache(1)
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """The trees, learned from `pages` made-up pages."""
    rows, labels = [], []
    for k in range(pages):
        page = Page(training_page(seed + k))
        x, y = page.features()
        # A node below one that isn't main has nothing to choose.
        open_ones = [i for i in range(1, len(y)) if y[page.parent[i]]]
        rows.append(x[open_ones])
        labels += [y[i] for i in open_ones]
    return Boosted().fit(np.concatenate(rows), np.array(labels, np.float64))


def extract_many(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; of a null or empty one the empty text."""
    pages = [Page(s) if s else None for s in sources]
    rows = [p.features()[0] for p in pages if p is not None]
    odds = model.log_odds(np.concatenate(rows)).tolist() if rows else []
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append(p.text(decode(p, odds[at : at + n])))
        at += n
    return out


def main_text(source: Column, context) -> Column:
    """The main text of a column of pages; empty for null."""
    shared = context.broadcast(trained())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(extract_many(part.tolist(), shared.value), dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()(source)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html), repeated rows too; other columns are ignored
    and an empty table gives no rows."""
    prepare(pages.sparkSession)
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), main_text(F.col("html"), pages.sparkSession.sparkContext).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
