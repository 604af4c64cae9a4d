"""HTML extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page's markup becomes a tree of block elements (inline elements only mark links). Every node gets features of its
tag, attribute tokens, depth, position, siblings and of its subtree: how much text, how dense, how much of it in links,
how much punctuation. Boosted trees give the log-odds that a node holds main text. Decoding then picks the labelling of
greatest total log-odds in which no node is kept below a dropped one: a container is kept for the sake of its
descendants or dropped with all of them, so contradictory choices can't occur.

The trees are trained in numpy on pages that ``make_page`` composes (no label of the corpus is needed): main text in
many kinds of containers among menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Defined results: null or empty html and pages without main text give an empty string; a page without any element is
its own text; unclosed and stray tags are read as browsers do for the common cases; repeated rows are extracted each
on its own; very long pages are handled whole, in time that grows with their length whatever markup they hold; an empty
table gives an empty result; input columns named ``text`` or ``n_chars`` give way to the outputs.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import steps

#: Elements that don't break a block, whose content is no text, that have no content, that end another.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math select button object audio video canvas".split())
VOID = frozenset("area base col embed hr input link meta param track".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements beyond which an end tag doesn't look for its start.
WALLS = frozenset(("#page", "td", "th", "table", "article", "body"))
#: Bytes of html that are worked on together (a longer page is a step of its own).
STEP_BYTES = 2 << 20

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its ``>``, which may stand inside quotes; possessive, so a failure costs one pass.
REST = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+(?=>)""", re.S)
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARK = ""


@dataclass
class Page:
    tags: list = field(default_factory=lambda: ["#page"])
    attributes: list = field(default_factory=lambda: [()])
    parents: list = field(default_factory=lambda: [-1])
    texts: list = field(default_factory=list)  # (node, block, text, inside a link)


class _Ends:
    """Where tags end. Passes over the page are few, whatever it holds: no tag can make the next one search in vain."""

    def __init__(self, source: str):
        self.source, self.next, self.table = source, -1, None

    def plain(self, at: int) -> int:
        """The next ``>`` from ``at``, -1 for none; calls come with rising ``at``."""
        if self.next is not None and self.next < at:
            found = self.source.find(">", at)
            self.next = found if found >= 0 else None
        return -1 if self.next is None else self.next

    def tag(self, at: int) -> int:
        """The ``>`` of the tag whose attributes begin at ``at``: outside quotes or, if no quote closes, the next one."""
        if self.plain(at) < 0:
            return -1
        if self.table is None:
            m = REST.match(self.source, at)
            if m:
                return m.end()
            self._tabulate()
        k = bisect_left(self.table[0], at)
        end = self.table[1][k] if k < len(self.table[0]) else -1
        return end if end >= 0 else self.plain(at)

    def _tabulate(self) -> None:
        """For each ``>`` and quote the end of a tag that meets it outside quotes, from the last one backwards."""
        places = [m.start() for m in SPECIAL.finditer(self.source)]
        ends, seen = [-1] * len(places), {}
        for k in range(len(places) - 1, -1, -1):
            c = self.source[places[k]]
            if c == ">":
                ends[k] = places[k]
            else:
                close = seen.get(c, len(places))
                ends[k] = ends[close + 1] if close + 1 < len(places) else -1
                seen[c] = k
        self.table = (places, ends)


class _Open:
    """The open elements, with the places of each name, so that an end tag finds its start without a walk."""

    def __init__(self, tags: list):
        self.tags, self.nodes, self.places, self.walls = tags, [0], {}, []

    def push(self, node: int) -> None:
        name = self.tags[node]
        self.places.setdefault(name, []).append(len(self.nodes))
        if name in WALLS:
            self.walls.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        name = self.tags[self.nodes.pop()]
        self.places[name].pop()
        if name in WALLS:
            self.walls.pop()

    def close(self, name: str) -> bool:
        """Ends the nearest element of that name that no wall hides, and all within it."""
        own = self.places.get(name)
        if not own or (name not in WALLS and self.walls and own[-1] < self.walls[-1]):
            return False
        for _ in range(len(self.nodes) - own[-1]):
            self.pop()
        return True


def parse(source: str) -> Page:
    page, links, block, at, look = Page(), 0, 0, 0, 0
    tags, texts, size = page.tags, page.texts, len(source)
    stack, ends = _Open(tags), _Ends(source)
    while at < size:
        start = source.find("<", look)
        if start < 0:
            texts.append((stack.nodes[-1], block, source[at:], links > 0))
            break
        m, after = None, -1
        if source.startswith("<!--", start):
            after = source.find("-->", start + 4) + 3
            after = after if after > 2 else size
        elif source.startswith("<![CDATA[", start):
            after = source.find("]]>", start + 9) + 3
            after = after if after > 2 else size
        elif source.startswith(("<!", "<?"), start):
            after = ends.plain(start) + 1 or size
        elif ends.plain(start) > 0 and (m := NAME.match(source, start)):
            after = ends.tag(m.end()) + 1
        if after <= 0:  # no markup: the sign is text
            look = start + 1
            continue
        if start > at:
            texts.append((stack.nodes[-1], block, source[at:start], links > 0))
        at = look = after
        if m is None:
            continue
        name, end, rest = m[2].lower(), m[1], source[m.end() : after - 1]
        if name in INLINE:
            if name == "a":
                links = 0 if end else 1
            elif name == "br":
                texts.append((stack.nodes[-1], block, " ", False))
            continue
        if end:
            if stack.close(name):
                links = 0
            block += 1
            continue
        if name in CLOSES_P and tags[stack.nodes[-1]] == "p":
            stack.pop()
        for other in ENDS.get(name, ()):
            if tags[stack.nodes[-1]] == other:
                stack.pop()
                break
        block += 1
        if name in RAW:
            close = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
            at = look = close.end() if close else size
        tokens = ()
        if "=" in rest and (found := ATTRIBUTE.findall(rest)):
            tokens = tuple(dict.fromkeys(p.lower() for v in found for p in PIECE.findall(v)))
        tags.append(name)
        page.attributes.append(tokens)
        page.parents.append(stack.nodes[-1])
        if name not in VOID and name not in RAW and not rest.endswith("/"):
            stack.push(len(tags) - 1)
    return page


# ------------------------------------------------------------------------------------------------ features

NAMES = (
    "tag", "attribute", "parent_tag", "parent_attribute", "worst_attribute_above", "best_attribute_above", "depth", "index", "siblings", "same_tag_siblings",
    "log_text", "log_own_text", "link_share", "nodes", "text_per_node", "page_share", "parent_share", "begins_at", "stops_per_char", "words_per_block",
    "mean_sibling_text", "inputs", "items", "has_attribute", "longest_block", "parent_page_share",
)


def raw_features(page: Page):
    """Features but for the learnt scores of tags and tokens (the first six columns), per node; texts cleaned."""
    n, parents, tags = len(page.tags), page.parents, page.tags
    own, linked, stops, words, blocks, longest = ([0] * n for _ in range(6))
    start, clean, total = [float("inf")] * n, [], 0
    for node, block, text, link in page.texts:
        t = html.unescape(text) if "&" in text else text
        size = len(t.strip())
        clean.append((node, block, t))
        if size:
            own[node] += size
            if link:
                linked[node] += size
            stops[node] += t.count(".") + t.count(",")
            words[node] += t.count(" ") + 1
            blocks[node] += 1
            if size > longest[node]:
                longest[node] = size
            if total < start[node]:
                start[node] = total
            total += size
    inputs = [int(t in ("input", "form", "button", "select", "textarea", "fieldset")) for t in tags]
    items = [int(t in ("li", "dd", "td", "option")) for t in tags]
    count, text, link, stop, word, blk, top = [1] * n, own[:], linked[:], stops[:], words[:], blocks[:], longest[:]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        count[p] += count[i]
        text[p] += text[i]
        link[p] += link[i]
        stop[p] += stop[i]
        word[p] += word[i]
        blk[p] += blk[i]
        inputs[p] += inputs[i]
        items[p] += items[i]
        if top[i] > top[p]:
            top[p] = top[i]
        if start[i] < start[p]:
            start[p] = start[i]
    depth, index, children, kinds = [0] * n, [0] * n, [0] * n, {}
    for i in range(1, n):
        p = parents[i]
        depth[i], index[i] = depth[p] + 1, children[p]
        children[p] += 1
        kinds[p, tags[i]] = kinds.get((p, tags[i]), 0) + 1
    parents = np.array(parents)
    own, count, text, link, stop, word, blk, top, start, inputs, items, children = (
        np.array(v, dtype=float) for v in (own, count, text, link, stop, word, blk, top, start, inputs, items, children)
    )
    up = np.maximum(parents, 0)
    whole = max(total, 1)
    f = np.zeros((n, len(NAMES)))
    f[:, 6], f[:, 7], f[:, 8] = depth, index, children[up]
    f[:, 9] = [kinds.get((p, t), 1) for p, t in zip(page.parents, tags, strict=True)]
    f[:, 10], f[:, 11] = np.log1p(text), np.log1p(own)
    f[:, 12], f[:, 13], f[:, 14] = link / np.maximum(text, 1), count, text / count
    f[:, 15], f[:, 16], f[:, 17] = text / whole, text / np.maximum(text[up], 1), np.where(np.isfinite(start), start, whole) / whole
    f[:, 18], f[:, 19] = stop / np.maximum(text, 1), word / np.maximum(blk, 1)
    f[:, 20] = (text[up] - text) / np.maximum(children[up] - 1, 1)
    f[:, 21], f[:, 22] = inputs, items / count
    f[:, 23], f[:, 24] = [float(bool(a)) for a in page.attributes], np.log1p(top)
    f[:, 25] = text[up] / whole
    return f, clean


def fill_scores(f: np.ndarray, page: Page, tag_score: dict, token_score: dict) -> np.ndarray:
    tag = np.array([tag_score.get(t, 0.0) for t in page.tags])
    token = np.array([min((token_score.get(x, 0.0) for x in a), default=0.0) if a else 0.0 for a in page.attributes])
    best = np.array([max((token_score.get(x, 0.0) for x in a), default=0.0) if a else 0.0 for a in page.attributes])
    worst, good = token.copy(), best.copy()
    for i, p in enumerate(page.parents):
        if p >= 0:
            worst[i], good[i] = min(worst[i], worst[p]), max(good[i], good[p])
    up = np.maximum(page.parents, 0)
    f[:, 0], f[:, 1], f[:, 2], f[:, 3], f[:, 4], f[:, 5] = tag, token + best, tag[up], (token + best)[up], worst, good
    return f


# ------------------------------------------------------------------------------------------------ boosted trees


@dataclass
class Boosted:
    """Complete binary trees of one depth in flat arrays: node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # [trees, inner]
    bound: np.ndarray
    value: np.ndarray  # [trees, leaves]
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, bound, value in zip(self.feature, self.bound, self.value, strict=True):
            k = np.zeros(len(x), np.int64)
            while inner and k[0:1].size and k[0] < inner:
                k = 2 * k + 1 + (x[rows, feature[k]] > bound[k])
            out += value[k - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 6, rate: float = 0.15, bins: int = 40, l2: float = 4.0, least: float = 8.0, share: float = 0.3, seed: int = 3) -> Boosted:
    """Second-order boosting of the logistic loss on binned features; each tree sees a random ``share`` of the nodes."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, j], side="left").astype(np.int32) for j, e in enumerate(edges)]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, inner, rng = np.full(len(y), base), 2**depth - 1, np.random.default_rng(seed)
    features, bounds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        own = np.flatnonzero(rng.random(len(y)) < share) if share < 1 else np.arange(len(y))
        p = 1 / (1 + np.exp(-z[own]))
        g, h, k, seen = p - y[own], p * (1 - p), np.zeros(len(own), np.int32), [c[own] for c in codes]
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = k - first
            best = np.full(width, 1e-6)
            gt, ht = np.bincount(at, g, width), np.bincount(at, h, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                m = len(e) + 1
                cell = at * m + seen[j]
                gl = np.cumsum(np.bincount(cell, g, width * m).reshape(width, m), 1)[:, :-1]
                hl = np.cumsum(np.bincount(cell, h, width * m).reshape(width, m), 1)[:, :-1]
                gain = gl**2 / (hl + l2) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + l2) - (gt**2 / (ht + l2))[:, None]
                gain[(hl < least / 4) | (ht[:, None] - hl < least / 4)] = -1
                c = gain.argmax(1)
                top = gain[np.arange(width), c]
                new = top > best
                best[new] = top[new]
                features[t, first : first + width][new], bounds[t, first : first + width][new] = j, e[c[new]]
            k = 2 * k + 1 + (x[own, features[t, k]] > bounds[t, k])
        leaf = k - inner
        values[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += Boosted(features[t : t + 1], bounds[t : t + 1], values[t : t + 1], 0.0).predict(x)
    return Boosted(features, bounds, values, base)


# ------------------------------------------------------------------------------------------------ decoding


def decode(odds: np.ndarray, parents) -> np.ndarray:
    """The labelling of greatest total log-odds in which whatever is kept has only kept ancestors."""
    best = odds.copy()
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    kept = best > 0
    for i in range(1, len(best)):
        kept[i] &= kept[parents[i]]
    return kept


@dataclass
class Extractor:
    trees: Boosted
    tag_score: dict
    token_score: dict

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s or "") for s in sources]
        made = [raw_features(p) for p in pages]
        if not pages:
            return []
        x = np.concatenate([fill_scores(f, p, self.tag_score, self.token_score) for (f, _), p in zip(made, pages, strict=True)])
        odds, at, out = self.trees.predict(x), 0, []
        for page, (f, clean) in zip(pages, made, strict=True):
            n = len(f)
            kept = decode(odds[at : at + n], page.parents) if n > 1 else np.ones(1, bool)
            at += n
            blocks: dict = {}
            for node, block, text in clean:
                if kept[node]:
                    blocks.setdefault(block, []).append(text)
            lines = (" ".join("".join(b).split()) for b in blocks.values())
            out.append("\n".join(x for x in lines if x))
        return out


# ------------------------------------------------------------------------------------------------ training pages


def make_page(r: random.Random) -> str:
    """A page whose main text is marked by MARK at the start of each of its texts."""
    syllables = "an be co da el fi go ha in jo ka lo me no or pa qui re sa to un vi wa xe yo zu th er ing tion".split()
    pick = lambda *xs: r.choice(xs)
    chance = lambda p: r.random() < p
    vocabulary = ["".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(80)]
    vocabulary = [w + pick("!!", "$$$", "%", " |") for w in vocabulary] if chance(0.08) else vocabulary[: pick(3, 20)] if chance(0.08) else vocabulary
    plain = chance(0.12)  # a page whose texts have no punctuation
    word = lambda: r.choice(vocabulary)

    def words(a, b):
        return " ".join(r.choices(vocabulary, k=r.randrange(a, b)))

    def sentence(a=4, b=18):
        s = words(a, b)
        return s if plain else s[0].upper() + s[1:] + pick(".", ".", ".", ",", "?", "!")

    def prose(a=1, b=9):
        return " ".join(sentence() for _ in range(r.randrange(a, b)))

    def name(*tokens):
        """Attributes with one of the tokens, more or less adorned; at times with none that tells anything."""
        if chance(0.12):
            return pick("", f' class="{word()}"', f' id="{word()}{r.randrange(99)}"')
        t = pick(*tokens)
        t = pick(t, t, f"{t}-{word()}", f"{word()}-{t}", f"{t} {word()}", f"{t}_{r.randrange(20)}")
        return pick(f' class="{t}"', f' class="{t}"', f' id="{t}"')

    def link():
        return f'<a href="/{word()}">{words(1, 4)}</a>'

    def items(a, b, inner):
        return "".join(f"<li>{inner()}{pick('</li>', '</li>', '')}" for _ in range(r.randrange(a, b)))

    def menu():
        tokens = ("nav", "menu", "navigation", "navbar", "breadcrumb", "topbar", "links", "pagination", "tabs")
        body = pick(f"<ul>{items(3, 10, link)}</ul>", " ".join(f"{link()}" for _ in range(r.randrange(3, 10))), f"<ol>{items(2, 6, link)}</ol>")
        return pick(f"<nav>{body}</nav>", f"<nav{name(*tokens)}>{body}</nav>", f"<div{name(*tokens)}>{body}</div>", f'<ul class="{pick(*tokens)}">{items(3, 9, link)}</ul>')

    def header():
        tokens = ("header", "masthead", "banner", "logo", "site", "top", "branding", "hero")
        body = pick(f"<h1>{words(1, 4)}</h1><p>{sentence()}</p>", f"<div>{words(1, 5)}</div>", f"<p>{words(2, 6)}</p>{menu()}", f"{link()} {words(1, 3)}")
        return pick(f"<header>{body}</header>", f"<header{name(*tokens)}>{body}</header>", f"<div{name(*tokens)}>{body}</div>")

    def footer():
        tokens = ("footer", "copyright", "bottom", "legal", "colophon", "credits")
        body = pick(f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{prose(1, 3)}</p>", f"<p>&copy; {words(1, 4)}</p><ul>{items(2, 6, link)}</ul>", f"<div>{sentence()} {link()}</div>")
        return pick(f"<footer>{body}</footer>", f"<footer{name(*tokens)}>{body}</footer>", f"<div{name(*tokens)}>{body}</div>")

    def sidebar():
        tokens = ("sidebar", "aside", "widget", "related", "rail", "side", "trending", "popular", "recommended", "secondary", "tags", "author")
        body = pick(f"<h3>{words(1, 4)}</h3><ul>{items(2, 8, link)}</ul>", f"<h2>{words(1, 4)}</h2><p>{prose(1, 4)}</p>", f"<p>{prose(1, 3)}</p>", f"<div><h4>{words(1, 3)}</h4>{prose(1, 3)}</div>")
        return pick(f"<aside>{body}</aside>", f"<aside{name(*tokens)}>{body}</aside>", f"<div{name(*tokens)}>{body}</div>", f"<section{name(*tokens)}>{body}</section>")

    def advert():
        tokens = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsense", "sponsor", "dfp", "promotion")
        body = pick(sentence(), prose(1, 4), f"<p>{prose(1, 3)}</p>", f"{link()}", f"<p>{sentence()}</p><p>{link()}</p>")
        return pick("", f"<!-- {pick('ad', 'slot')} {r.randrange(9)} -->") + pick(f"<div{name(*tokens)}>{body}</div>", f"<aside{name(*tokens)}>{body}</aside>", f"<section{name(*tokens)}>{body}</section>")

    def notice():
        tokens = ("cookie", "consent", "notice", "alert", "gdpr", "modal", "popup", "newsletter", "subscribe", "paywall", "message", "warning", "banner", "privacy")
        body = pick(f"<p>{prose(1, 4)}</p>", prose(1, 3), f"<p>{sentence()}</p><button>{words(1, 3)}</button>", f"<div>{prose(1, 3)}{link()}</div>")
        return pick(f"<div{name(*tokens)}>{body}</div>", f'<div role="{pick("alert", "dialog")}"{name(*tokens)}>{body}</div>', f"<section{name(*tokens)}>{body}</section>")

    def form():
        body = "".join(pick(f"<label>{words(1, 4)}</label><input name=x>", f"<p>{sentence()}</p><input>", f"<select><option>{word()}</option></select>", f"<div>{words(2, 8)}<textarea>{word()}</textarea></div>") for _ in range(r.randrange(1, 4)))
        return f"<form{pick('', name('search', 'login', 'contact', 'form', 'signup'))}>{body}<button>{word()}</button></form>"

    def comments():
        tokens = ("comments", "comment", "discussion", "replies", "responses", "disqus", "thread", "feedback", "reviews")
        one = lambda: pick(f"<p>{prose(1, 5)}</p>", f"<b>{word()}</b> {prose(1, 4)}", f"<h4>{word()}</h4><p>{prose(1, 4)}</p>", f"<span>{word()}</span><p>{prose(1, 3)}</p><p>{prose(1, 4)}</p>")
        many = "".join(pick(f"<div{name('comment', 'reply', 'comment', 'review')}>{one()}</div>", f"<div>{one()}</div>", f"<article{name('comment')}>{one()}</article>") for _ in range(r.randrange(1, 6)))
        body = pick("", f"<h3>{words(1, 4)}</h3>") + pick(many, f"<ol>{items(1, 6, one)}</ol>", f"<ul>{items(1, 6, one)}</ul>") + pick("", form())
        return pick(f"<div{name(*tokens)}>{body}</div>", f"<section{name(*tokens)}>{body}</section>")

    def block():
        kind = r.random()
        if kind < 0.62:
            p = prose(1, 9)
            return pick(f"<p>{MARK}{p}</p>", f"<p>{MARK}{p}</p>", f"<p>{MARK}{p}</p>", f"<p>{MARK}<b>{sentence()}</b> {p}", f"<p><b>{MARK}{p}<br>", f"<p>{MARK}{p} {link()} {sentence()}</p>", f"<p>{MARK}{word()}.</p>", f"<p{name('text', 'paragraph', 'lead')}>{MARK}{p}</p>")
        if kind < 0.74:
            h = pick("h2", "h3", "h4")
            return f"<{h}>{MARK}{words(1, 8)}</{h}>"
        if kind < 0.82:
            return pick("<ul>{}</ul>", "<ol>{}</ol>").format(items(2, 7, lambda: MARK + pick(sentence(), prose(1, 3), words(2, 6))))
        if kind < 0.87:
            return f"<blockquote>{pick(MARK + prose(1, 4), f'<p>{MARK}{prose(1, 4)}</p>')}</blockquote>"
        if kind < 0.91:
            return f"<pre>{MARK}{prose(1, 4)}</pre>"
        if kind < 0.95:
            row = lambda: "<tr>" + "".join(f"<td>{MARK}{words(1, 5)}</td>" for _ in range(3)) + "</tr>"
            return f"<table>{''.join(row() for _ in range(r.randrange(2, 6)))}</table>"
        return pick(f"<figure><img src=x><figcaption>{MARK}{sentence()}</figcaption></figure>", f"<div>{MARK}{prose(1, 5)}</div>", f"<section><h3>{MARK}{words(1, 5)}</h3><p>{MARK}{prose(1, 5)}</p></section>")

    def main():
        tokens = ("content", "post", "entry", "article", "story", "main", "body", "text", "page", "single", "blog")
        title = words(2, 12)
        parts = [pick(f"<h1>{MARK}{title}</h1>", f"<h1>{MARK}{title}</h1>", f"<h2>{MARK}{title}</h2>", f"<header><h1>{MARK}{title}</h1></header>", "")]
        for _ in range(pick(r.randrange(1, 4), r.randrange(1, 16), r.randrange(1, 16), r.randrange(16, 40))):
            parts.append(block())
            if chance(0.12):
                parts.append(pick(advert, advert, notice, sidebar, form, menu)())
        if chance(0.15):
            parts.append(comments())
        body = "".join(parts)
        if chance(0.3):
            body = f"<div{name(*tokens)}>{body}</div>"
        return pick(f"<article>{body}</article>", f"<article{name(*tokens)}>{body}</article>", f"<main>{body}</main>", f"<main{name(*tokens)}>{body}</main>", f"<div{name(*tokens)}>{body}</div>", f"<section{name(*tokens)}>{body}</section>", f"<main><article>{body}</article></main>")

    before = [f() for f in (header, menu, notice, advert, sidebar, form) if chance(0.4)]
    after = [f() for f in (sidebar, comments, advert, notice, menu, form) if chance(0.35)]
    head = f"<head><meta charset=utf-8><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    middle = main()
    if chance(0.3):
        middle = f"<div{name('wrapper', 'container', 'layout', 'row', 'page')}>{middle}{pick('', sidebar())}</div>"
    body = "".join(before) + middle + "".join(after) + (footer() if chance(0.85) else "")
    if chance(0.2):
        body = f"<div{name('wrapper', 'container', 'site', 'app')}>{body}</div>"
    return f"<!DOCTYPE html><html lang=en>{head}<body>{body}{pick('</body></html>', '</body></html>', '')}"


@lru_cache(maxsize=2)
def train(pages: int = 1200, seed: int = 17, **how) -> Extractor:
    """The same pages and trees at every call, so a process fits them once."""
    r = random.Random(seed)
    parsed = [parse(make_page(r)) for _ in range(pages)]
    feats, labels = [], []
    for page in parsed:
        marked = np.zeros(len(page.tags), bool)
        for node, _, text, _ in page.texts:
            marked[node] |= MARK in text
        for i in range(len(marked) - 1, 0, -1):
            marked[page.parents[i]] |= marked[i]
        page.texts = [(a, b, t.replace(MARK, ""), c) for a, b, t, c in page.texts]
        feats.append(raw_features(page)[0])
        labels.append(marked)
    y = np.concatenate(labels).astype(float)
    counts: dict = {}
    for page, marked in zip(parsed, labels, strict=True):
        for tag, tokens, m in zip(page.tags, page.attributes, marked, strict=True):
            for key in (("tag", tag), *(("token", t) for t in tokens)):
                c = counts.setdefault(key, [0, 0])
                c[int(m)] += 1
    rate = y.mean()
    odds = lambda c: float(np.log((c[1] + 3 * rate) / (c[0] + 3 * (1 - rate))) - np.log(rate / (1 - rate)))
    tag_score = {k[1]: odds(c) for k, c in counts.items() if k[0] == "tag"}
    token_score = {k[1]: odds(c) for k, c in counts.items() if k[0] == "token" and sum(c) >= 8}
    x = np.concatenate([fill_scores(f, p, tag_score, token_score) for f, p in zip(feats, parsed, strict=True)])
    return Extractor(boost(x, y, **how), tag_score, token_score)


def extract(pages: DataFrame, extractor: Extractor | None = None, carry: list[str] | None = None, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every row; ``carry``: the columns that stay (all but those two unless given)."""
    names = carry or [n for n in pages.columns if n not in ("text", "n_chars")]
    read = names if column in names else [*names, column]
    bc = pages.sparkSession.sparkContext.broadcast(extractor or train())  # fixed size: the trees

    def run(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(read.index(column))), 0).to_numpy(zero_copy_only=False)
            for i, j in steps(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), STEP_BYTES):
                part = batch.slice(i, j - i)
                out = bc.value.texts(part.column(read.index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields] + ["text string", "n_chars long"])
    return pages.select(*read).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), carry=["page_id", "url"])
