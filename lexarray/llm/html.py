"""Main text of web pages: boosted trees judge the DOM's block nodes, a decoding over the tree keeps the judgements consistent."""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables

#: HTML's elements by how they are laid out and closed.
BLOCKS = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe select svg math object canvas audio video button option head".split())
_HEADED = set("html head base basefont bgsound link meta noscript script style template title".split())
_LITERAL = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_WITHIN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Attribute tokens that speak for and against main text.
FOR = set("article body content entry main post story text page prose blog news single maincontent articlebody".split())
AGAINST = set(
    "ad ads adv advert advertisement adslot banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar footer foot bottom copyright legal sidebar side aside widget rail related recommended "
    "more share sharing social comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notification alert modal popup overlay subscribe subscription newsletter signup login search form pagination pager tags meta byline hidden skip".split()
)
_TAGS = ("article", "main", "section", "div", "p", "h1", "ul", "li", "table", "nav", "header", "footer", "aside", "form")
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Block nodes of a page in the order of their start tags, and its text blocks in page order.

    A text block is what stands between two starts or ends of block elements, with character references
    decoded and white space turned into single spaces; it belongs to the block node around it.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.good, self.bad, self.mark = ["body"], [-1], [0], [0], [None]
        self.texts: list[tuple[int, str]] = []
        self.links: list[int] = []
        stack: list[tuple[str, int]] = [("body", 0)]
        # where in the stack each name, and any block, stands: no search has to walk the elements between
        places: dict[str, list[int]] = defaultdict(list)
        blocks: list[int] = []
        raw = link = 0
        buffer: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal buffer, linked
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                if text:
                    self.texts.append((stack[-1][1], text))
                    self.links.append(min(linked, len(text)))
                buffer, linked = [], 0

        def pop_to(k: int) -> None:
            nonlocal raw, link
            for name, _ in stack[k:]:
                raw -= name in RAW
                link -= name == "a"
                places[name].pop()
            del stack[k:]
            while blocks and blocks[-1] >= k:
                blocks.pop()

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stack[-1][0] == "head" and html[at:stop].strip():  # text ends a head, as in browsers
                pop_to(len(stack) - 1)
            if stop > at and not raw:
                buffer.append(html[at:stop])
                if link:
                    linked += stop - at
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if places[name]:
                    k = places[name][-1]
                    if blocks and blocks[-1] >= k:
                        flush()
                    pop_to(k)
                elif name in BLOCKS:
                    flush()
                continue
            if stack[-1][0] == "head" and name not in _HEADED:
                pop_to(len(stack) - 1)
            if name == "br":
                buffer.append(" ")
                continue
            block = name in BLOCKS
            if name in ("html", "body"):
                flush()
                continue
            if block:
                flush()
                shut, walls = _CLOSES.get(name, ()), _WITHIN.get(name, ())
                if blocks and stack[blocks[-1]][0] == "p":
                    pop_to(blocks[-1])
                wall = max((places[x][-1] for x in walls if places[x]), default=0)
                low = min((places[x][k] for x in shut if (k := bisect(places[x], wall)) < len(places[x])), default=None)
                if low is not None:
                    pop_to(low)
            if name in VOID:
                continue
            if name in _LITERAL:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
                continue
            node = stack[-1][1]
            if block and not raw:
                good = bad = 0
                mark = None
                for a in _ATTR.finditer(m[3]):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "data-keep":
                        mark = value
                    else:
                        for t in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
                            good += t in FOR
                            bad += t in AGAINST
                self.tag.append(name)
                self.parent.append(node)
                self.good.append(good)
                self.bad.append(bad)
                self.mark.append(mark)
                node = len(self.tag) - 1
            places[name].append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append((name, node))
            raw += name in RAW
            link += name == "a"
        flush()

    def features(self) -> np.ndarray:
        """A row for each node: its tag, place, attribute tokens, and densities of its subtree."""
        n = len(self.tag)
        parent = self.parent
        chars, linked, words, stops, own, blocks = ([0] * n for _ in range(6))
        for (node, text), x in zip(self.texts, self.links):
            chars[node] += len(text)
            own[node] += len(text)
            linked[node] += x
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",")
            blocks[node] += 1
        nodes, paras, items, index, siblings = [1] * n, [t == "p" for t in self.tag], [t == "li" for t in self.tag], [0] * n, [0] * n
        depth, bad_above, good_above, out_above = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = siblings[p]
            siblings[p] += 1
            bad_above[i] = bad_above[p] + self.bad[p]
            good_above[i] = good_above[p] + self.good[p]
            out_above[i] = out_above[p] + (self.tag[p] in _OUTSIDE) + (self.tag[p] == "header")
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (chars, linked, words, stops, blocks, nodes, paras, items):
                x[p] += x[i]
        seen, order = 0, [1 << 60] * n
        for node, text in self.texts:
            order[node] = min(order[node], seen)
            seen += len(text)
        for i in range(n - 1, 0, -1):
            order[parent[i]] = min(order[parent[i]], order[i])
        total = max(1, chars[0])
        out = np.empty((n, 23 + len(_TAGS)), np.float32)
        for i in range(n):
            p = max(parent[i], 0)
            c = chars[i]
            tag, above = self.tag[i], self.tag[p]
            out[i] = (
                min(depth[i], 30),
                index[i],
                siblings[p],
                self.good[i],
                self.bad[i],
                good_above[i],
                bad_above[i],
                out_above[i],
                c,
                c / total,
                c / max(1, chars[p]),
                linked[i] / c if c else 0,
                linked[p] / chars[p] if chars[p] else 0,
                words[i] / blocks[i] if blocks[i] else 0,
                stops[i] / words[i] if words[i] else 0,
                c / nodes[i],
                own[i] / c if c else 0,
                paras[i],
                items[i],
                paras[p] / nodes[p],
                (order[i] / total) if order[i] < 1 << 60 else 1,
                above in ("article", "main"),
                tag[0] == "h" and tag[1:].isdigit(),
                *(tag == t for t in _TAGS),
            )
        return out

    def labels(self) -> np.ndarray:
        """Of a marked page: whether a node is or holds main text."""
        n = len(self.tag)
        keep = [None] * n
        for i in range(n):
            keep[i] = int(self.mark[i]) if self.mark[i] is not None else keep[self.parent[i]] if i else None
        holds = [k == 1 for k in keep]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        return np.array(holds, np.float32)

    def kept(self, odds: np.ndarray) -> list[bool]:
        """The nodes kept: of all sets that hold each node's parent, one with the largest sum of log odds."""
        n = len(self.tag)
        gain = odds.astype(float).tolist()
        for i in range(n - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = [True] * n
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and gain[i] > 0
        keep[0] = any(keep[1:]) or odds[0] > 0 and n == 1
        return keep

    def text(self, odds: np.ndarray) -> str:
        keep = self.kept(odds)
        return "\n\n".join(t for node, t in self.texts if keep[node])


class Boosted:
    """Gradient-boosted trees for log odds: histograms over quantile bins, level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> None:
        n, m = x.shape
        self.depth = depth
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int64)
        self.cut = np.full((trees, (1 << depth) - 1), np.inf, np.float32)
        self.leaf = np.zeros((trees, 1 << depth), np.float32)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                size, first = 1 << level, (1 << level) - 1
                place = ((at[:, None] * m + np.arange(m)) * bins + binned).reshape(-1)
                gs = np.bincount(place, np.repeat(g, m), size * m * bins).reshape(size, m, bins).cumsum(2)
                hs = np.bincount(place, np.repeat(h, m), size * m * bins).reshape(size, m, bins).cumsum(2)
                value = lambda a, b: a * a / (b + ridge)
                gain = value(gs, hs) + value(gs[..., -1:] - gs, hs[..., -1:] - hs) - value(gs[..., -1:], hs[..., -1:])
                best = gain.reshape(size, -1).argmax(1)
                f, b = best // bins, best % bins
                ok = gain.reshape(size, -1).max(1) > 1e-3
                for k in range(size):
                    self.feature[t, first + k] = f[k]
                    self.cut[t, first + k] = cuts[f[k]][b[k]] if ok[k] and b[k] < len(cuts[f[k]]) else np.inf
                at = 2 * at + (x[np.arange(n), f[at]] > self.cut[t, first + at])
            gl, hl = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
            self.leaf[t] = rate * gl / (hl + ridge)
            score += self.leaf[t][at]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def sample_pages(n: int, seed: int = 11) -> Iterator[str]:
    """Made-up pages of many layouts whose nodes are marked with data-keep: what the trees learn from."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(k: int) -> str:
        return " ".join("".join(pick("aeiourstnlmdpkéüñ") for _ in range(rng.randint(2, 9))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join(words(rng.randint(2, 14)).capitalize() + "." for _ in range(k))

    def attr(names: list[str], keep: str = "", p: float = 0.7) -> str:
        out = f' data-keep="{keep}"' if keep else ""
        if chance(p):
            out += f' {pick(["class", "id", "class"])}="{pick(["", "", "site-", "page-", "c-", "js-"])}{pick(names)}{pick(["", "", "-wrap", "-box", "_1", "-inner"])}"'
        return out

    def links(k: int) -> str:
        items = "".join(f"<li><a href='/x'>{words(rng.randint(1, 3))}</a></li>" for _ in range(k))
        return f"<ul>{items}</ul>" if chance(0.8) else " | ".join(f"<a href='#'>{words(2)}</a>" for _ in range(k))

    def paragraph() -> str:
        text = sentences(rng.choice([1, 1, 2, 3, 5, 9, 15]))
        if chance(0.15):
            text += f" <a href='/y'>{words(3)}</a> {sentences(1)}"
        if chance(0.15):
            text = f"<b>{words(4)}<br>" + text
        return pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(text)

    def framed(tags: list[str], names: list[str], inner: str) -> str:
        """Elements that say what they are by their name often have no class."""
        tag = pick(tags)
        return f"<{tag}{attr(names, '0', 0.4 if tag in ('nav', 'header', 'footer', 'aside') else 1)}>{inner}</{tag}>"

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            return framed(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "breadcrumb"], links(rng.randint(3, 12)))
        if kind == "header":
            return framed(["header", "header", "div"], ["header", "masthead", "topbar"], f"<{(t := pick(['h1', 'h2', 'div', 'p']))}>{words(3)}</{t}>" + pick(["", links(rng.randint(1, 6)), f"<p>{words(6)}</p>"]))
        if kind == "footer":
            inner = f"&copy; {words(2)} &middot; {sentences(1)}" if chance(0.6) else f"<p>{sentences(2)}</p>{links(5)}"
            return framed(["footer", "footer", "div"], ["footer", "bottom", "copyright", "legal"], inner)
        if kind == "ad":
            return framed(["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "banner"], pick([sentences(rng.randint(1, 4)), f"<p>{sentences(2)}</p>", f"<a href='/b'>{words(6)}</a>"]))
        if kind == "side":
            inner = f"<h3>{words(2)}</h3>" + pick([links(6), f"<p>{sentences(3)}</p>", f"<p>{sentences(2)}</p>{links(3)}"])
            return framed(["aside", "aside", "div", "section"], ["sidebar", "related", "widget", "recommended", "side"], inner)
        if kind == "notice":
            return f"<{(t := pick(['div', 'section', 'dialog', 'aside']))}{attr(['cookie', 'notice', 'consent', 'alert', 'gdpr', 'popup', 'cookie-banner'], '0', 1)}><p>{sentences(rng.randint(1, 4))}</p><button>{words(1)}</button></{t}>"
        if kind == "form":
            return f"<form{attr(['subscribe', 'search', 'login', 'newsletter', 'signup'], '0')}><label>{words(2)}</label><input name=q>{f'<p>{sentences(1)}</p>' if chance(0.5) else ''}<button>{words(1)}</button></form>"
        if kind == "share":
            return f"<div{attr(['share', 'social', 'tags', 'byline', 'meta'], '0', 1)}>{pick([links(4), words(5)])}</div>"
        comments = "".join(f"<{(t := pick(['div', 'li', 'article']))}{attr(['comment', 'reply'])}><p>{words(2)}</p><p>{sentences(rng.randint(1, 6))}</p></{t}>" for _ in range(rng.randint(1, 6)))
        return f"<{(t := pick(['section', 'div', 'ol']))}{attr(['comments', 'discussion', 'respond', 'replies'], '0', 1)}><h2>{words(2)}</h2>{comments}</{t}>"

    def article() -> str:
        parts = [f"<{(t := pick(['h1', 'h1', 'h1', 'h2']))}>{words(rng.randint(3, 10))}</{t}>"] if chance(0.85) else []
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 5, 8, 14, 25])):
            parts.append(paragraph())
            if chance(0.12):
                parts.append(f"<h2>{words(4)}</h2>")
            if chance(0.08):
                parts.append("<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            if chance(0.06):
                parts.append(f"<blockquote><p>{sentences(2)}</p></blockquote>")
            if chance(0.04):
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(3)}</td></tr>" for _ in range(3)) + "</table>")
            if chance(0.06):
                parts.append(f"<pre>{words(8)}</pre>")
            if chance(0.06):
                parts.append(boilerplate(pick(["ad", "share", "form", "side", "notice"])))
        if chance(0.3):
            parts.append(boilerplate(pick(["share", "side", "form", "comments"])))
        return pick(["<article{}>{}</article>", "<article{}>{}</article>", "<main{}>{}</main>", "<div{}>{}</div>", "<section{}>{}</section>", "<td{}>{}</td>"]).format(attr(["content", "article", "post", "entry", "story", "text", "main", "body"], "1", 0.5), "".join(parts))

    for _ in range(n):
        above = [boilerplate(k) for k in ("header", "nav", "notice", "ad", "form", "side") if chance(0.4)]
        below = [boilerplate(k) for k in ("comments", "side", "form", "ad", "share", "notice", "nav", "footer") if chance(0.4)]
        rng.shuffle(above)
        middle = article()
        if chance(0.05):
            middle = ""
        for _ in range(rng.randint(0, 3)):
            middle = f"<div{attr(['wrapper', 'container', 'row', 'col', 'layout', 'page', 'main', 'content'])}>{''.join(boilerplate(pick(['side', 'ad', 'nav', 'share'])) for _ in range(rng.choice([0, 0, 1])))}{middle}</div>"
        html = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{''.join(above)}{middle}{''.join(below)}"
        yield html if chance(0.1) else html + "</body></html>"


def trained(pages: int = 1500) -> Boosted:
    """Trees fitted to `pages` made-up pages, a fixed number; the pages to extract are not learned from."""
    made = [Page(x) for x in sample_pages(pages)]
    return Boosted(np.concatenate([p.features() for p in made]), np.concatenate([p.labels() for p in made]))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    text: the kept text blocks in page order, joined by two newlines. Cases: null, empty and textless html give
    an empty text; markup that is never closed is closed as browsers do; pages of any length are read whole;
    repeated rows are extracted each; an empty table gives no rows; other columns are ignored.
    """
    model = tables.sent(pages.sparkSession, (lambda b: (b.base, b.depth, b.feature, b.cut, b.leaf))(trained()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Boosted.__new__(Boosted)
        trees.base, trees.depth, trees.feature, trees.cut, trees.leaf = model.value
        for batch in batches:
            for a in range(0, len(batch.column(0)), 500):
                part = batch.slice(a, 500)
                parsed = [Page(x or "") for x in part.column(2).to_pylist()]
                rows = [p.features() for p in parsed]
                odds = np.split(trees.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                text = [p.text(o) for p, o in zip(parsed, odds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
