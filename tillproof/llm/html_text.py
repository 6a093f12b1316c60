"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that isn't inline is a node with a label, content or not. A node has a potential from
its tag, names, text and links; parent and child have one by the kind of their edge. Sum-product
messages upward and downward give exact marginals, for all pages of a batch at once, a depth at a time.
Text whose node is more likely content than not is kept. The model is trained on labelled_pages():
pages composed by rule from common layouts, whose labels are known by construction.

Edge cases: null, empty and text-free pages give an empty text and 0; unclosed and stray tags are
handled as browsers do for paragraphs, list items, cells and options; a page without tags is one block of
text; equal pages get equal rows; null ids and urls pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import in_batches, texts

TAG = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)""", re.S)
NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template button iframe object svg canvas video audio head".split())
#: Of those, the ones that run to the end of the page where their end tag is missing.
ENDLESS = frozenset("script style textarea title".split())
#: Lists to choose from: their text is never kept, and any other block ends them.
CHOICES = frozenset("select datalist optgroup option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that an opening tag ends when they are still open, and what the search doesn't pass.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select", "datalist"})}
GROUPS = [{"article", "main"}, {"section", "div", "center"}, {"p", "pre", "blockquote"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "li", "dl", "dt", "dd", "menu"}, {"table", "tbody", "thead", "tr", "td", "th", "caption"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "dialog", "select", "datalist", "optgroup", "option"}, {"figure", "figcaption", "details", "summary"}, {"html", "body", "#root"}]
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|foot\w*|head|header|masthead|top-?bar|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comments?|comment-\w+|disqus|replies|reply|tags?|widget|pagination|pager|toc|skip|copyright|legal|search|toolbar|rail|teaser)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|post-body|entry\w*|story\w*|body|text|main\w*|page-content|prose)(?:$|[\s_-])", re.I)
CUES = re.compile(r"©|&copy;|all rights reserved|cookie|subscribe|sign up|log in|advertis|sponsored|privacy policy|terms of|share this|follow us|newsletter|read more|related (?:posts|articles)|leave a (?:reply|comment)", re.I)
EDGES, WIDTH = 4, len(GROUPS) + 16


class Page:
    """Nodes of a page in order: parent, depth, tag, names, and blocks of text as (node, text)."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.names = [-1], [0], ["#root"], [""]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, text, links, at, size = [0], [], 0, 0, len(source)
        opened: dict[str, list[int]] = {}  # places in the stack of each tag that is open, so that no search walks the stack
        endless: set[str] = set()  # tags without any further end tag

        def end_block() -> None:
            nonlocal text
            if text:
                plain = SPACES.sub(" ", html.unescape("".join(text))).strip()
                text = []
                if plain and self.tag[stack[-1]] not in CHOICES:
                    self.blocks.append((stack[-1], plain))
                    self.chars[stack[-1]] += len(plain)

        def pop(to: int) -> None:
            end_block()
            for k in stack[to:]:
                opened[self.tag[k]].pop()
            del stack[to:]

        def last(*tags: str) -> int:
            """The highest place in the stack of any of the tags; 0 if none is open."""
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        while at < size:
            m = TAG.search(source, at)
            if m is None:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at : m.start()])
                if links:
                    self.linked[stack[-1]] += m.start() - at
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW and not closing:
                if name != "head" and not attributes.endswith("/"):
                    end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    if end is None:
                        endless.add(name)
                    at = end.end() if end else size if name in ENDLESS else at
                elif name == "head":
                    end = re.compile(r"</head\s*>|<body", re.I).search(source, at)
                    at = (end.end() if end[0][1] == "/" else end.start()) if end else at
                text.append(" ")
                continue
            if name in ("br", "hr") or name in VOID:
                text.append(" ")
                if name == "hr":
                    end_block()
                continue
            if name in INLINE or (name not in GROUP and "-" not in name and name not in CLOSES_P):
                if name == "a":
                    links = 0 if closing else 1
                continue
            if closing:
                links = 0
                k = last(name)
                if k and (name != "p" or k == len(stack) - 1):
                    pop(k)
                continue
            end_block()
            links = 0
            while name not in CHOICES and self.tag[stack[-1]] in CHOICES:
                pop(len(stack) - 1)
            if name in CLOSES_P and (k := last("p")) > last("td", "th", "table", "button", "object"):
                pop(k)
            if name in ENDS:
                over, stop = ENDS[name]
                while (k := last(*over)) > last(*stop):
                    pop(k)
                    if name != "tr":
                        break
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tag.append(name)
            self.names.append(" ".join(x for g in NAMES.findall(attributes) for x in g if x) if attributes else "")
            self.chars.append(0)
            self.linked.append(0)
            opened.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
        end_block()


def known(names: str, memo: dict[str, tuple[bool, bool]]) -> tuple[bool, bool]:
    if (got := memo.get(names)) is None:
        if len(memo) > 50_000:
            memo.clear()
        got = memo[names] = (bool(BAD.search(names)), bool(GOOD.search(names)))
    return got


class Forest:
    """The nodes of many pages as arrays: parents before children within a page."""

    def __init__(self, pages: list[Page], memo: dict):
        sizes = np.fromiter((len(p.tag) for p in pages), np.int64, len(pages))
        first = np.cumsum(sizes) - sizes
        base = np.repeat(first, sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, int(sizes.sum()))
        self.root = parent < 0
        self.parent = np.where(self.root, -1, parent + base)
        self.depth = np.fromiter((x for p in pages for x in p.depth), np.int64, len(parent))
        own = np.fromiter((x for p in pages for x in p.chars), float, len(parent))
        linked = np.fromiter((x for p in pages for x in p.linked), float, len(parent))
        self.first = first
        self.levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])
        all_chars, all_linked, children = own.copy(), linked.copy(), np.zeros(len(own))
        for level in self.levels[:0:-1]:
            np.add.at(all_chars, self.parent[level], all_chars[level])
            np.add.at(all_linked, self.parent[level], all_linked[level])
            np.add.at(children, self.parent[level], 1)
        whole = np.repeat(all_chars[first], sizes)
        group = np.fromiter((GROUP.get(t, 1) for p in pages for t in p.tag), np.int64, len(parent))
        names = np.array([known(x, memo) for p in pages for x in p.names], bool).reshape(-1, 2)
        cue = np.zeros(len(own))
        for b, p in zip(first.tolist(), pages, strict=True):
            for node, text in p.blocks:
                if len(text) < 300 and CUES.search(text):
                    cue[b + node] = 1
        density = all_linked / np.maximum(all_chars, 1)
        x = np.zeros((len(own), WIDTH))
        x[np.arange(len(own)), group] = 1
        k = len(GROUPS)
        x[:, k], x[:, k + 1] = names[:, 0], names[:, 1] & ~names[:, 0]
        x[:, k + 2] = (density > 0.5) & (all_chars > 0)
        x[:, k + 3], x[:, k + 4], x[:, k + 5] = (own > 0) & (own < 25), (own >= 25) & (own < 80), own >= 80
        x[:, k + 6] = all_chars / np.maximum(whole, 1) > 0.4
        x[:, k + 7], x[:, k + 8] = cue, (density > 0.2) & (density <= 0.5)
        above = np.where(self.root, 0, self.parent)
        x[:, k + 9] = x[above, k]
        x[:, k + 10] = x[above, 0]
        bad = x[:, k].astype(bool) | np.isin(group, (6, 8, 9, 10))
        for level in self.levels[1:]:  # whether an ancestor looks like boilerplate
            bad[level] |= bad[self.parent[level]]
        x[:, k + 11] = bad
        inside = group == 0
        for level in self.levels[1:]:
            inside[level] |= inside[self.parent[level]]
        x[:, k + 12] = inside
        x[:, k + 13] = inside & bad
        x[:, k + 14] = ~np.repeat(np.logical_or.reduceat(inside, first), sizes) & ~bad
        x[:, k + 15] = 1
        self.x = x
        wall = np.isin(group, (6, 7, 8, 9, 10)) | names[:, 0]
        self.edge = np.where(wall, 0, np.where(group[above] == 0, 1, np.where(np.isin(group, (2, 3)), 2, 3)))


class Model:
    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of content of each node; and, of each edge to a parent, the table of both labels' probabilities."""
        s = f.x @ self.unary
        e = self.pair[f.edge]
        up = np.zeros(len(s))
        for level in f.levels[:0:-1]:  # upward
            a = e[level]
            up[level] = np.logaddexp(a[:, 1, 1] + s[level], a[:, 1, 0]) - np.logaddexp(a[:, 0, 1] + s[level], a[:, 0, 0])
            np.add.at(s, f.parent[level], up[level])
        belief, q = s.copy(), np.zeros(len(s))
        for level in f.levels[1:]:  # downward
            a = e[level]
            q[level] = belief[f.parent[level]] - up[level]
            belief[level] += np.logaddexp(q[level] + a[:, 1, 1], a[:, 0, 1]) - np.logaddexp(q[level] + a[:, 1, 0], a[:, 0, 0])
        both = e + np.stack([np.stack([np.zeros(len(s)), s], 1), np.stack([q, q + s], 1)], 1)
        both = np.exp(both - both.max((1, 2), keepdims=True))
        both /= both.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(-belief.clip(-40, 40))), both, s

    def text(self, pages: list[Page], memo: dict) -> list[str]:
        f = Forest(pages, memo)
        keep = self.marginals(f)[0] >= 0.5
        return ["\n".join(t for node, t in p.blocks if keep[b + node]) for b, p in zip(f.first.tolist(), pages, strict=True)]


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, frozenset[str]]]:
    """Pages composed from common layouts, each with the set of its content blocks; drawn by rule."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bcdfglmnprstv") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    out = []
    for _ in range(n):
        content: set[str] = set()

        def say(lo: int, hi: int) -> str:
            return " ".join(word() for _ in range(draw.randint(lo, hi))).capitalize() + "."

        def real(lo: int, hi: int, content: set = content) -> str:
            content.add(text := say(lo, hi))
            return text

        link = lambda: f'<a href="/{word()}">{word()}</a>'
        links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
        paragraphs = "".join(draw.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<div>{}</div>"]).format(real(1, 60)) for _ in range(draw.randint(1, 12)))
        title = f"<h1>{real(1, 10)}</h1>"
        if draw.random() < 0.2:
            title = f"<header>{title}</header>"
        inner = draw.choice(["", "", f'<div class="ad">{say(3, 12)}</div>', f'<aside class="related">{links(3)}</aside>', f'<div class="share">{link()} {link()}</div>', f'<form><label>{say(1, 3)}</label><input></form>'])
        body = title + paragraphs + inner
        main = draw.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content"><div class="post">{}</div></div>', '<div class="entry-content">{}</div>', "<div>{}</div>", "<section>{}</section>"]).format(body)
        comments = "".join(f'<{t} class="comment"><p>{say(3, 40)}</p></{t}>' for t in [draw.choice(["div", "article", "li"])] for _ in range(draw.randint(1, 4)))
        before = ["", f"<nav>{links(draw.randint(2, 7))}</nav>", f"<header><p>{say(1, 6)}</p>{links(3)}</header>", f'<div class="menu">{links(5)}</div>', f'<div class="cookie-notice"><p>{say(5, 20)}</p></div>', f'<div class="ad">{say(3, 25)}</div>', f'<div id="header"><h2>{say(1, 4)}</h2></div>', f'<div class="breadcrumbs">{link()} &gt; {link()}</div>', f'<div class="alert">{say(4, 15)}</div>']
        after = ["", f"<footer><p>&copy; {say(2, 9)}</p></footer>", f"<footer>&copy; {say(2, 9)} &middot; {say(4, 14)}</footer>", f'<aside><h3>{say(1, 3)}</h3><p>{say(5, 40)}</p></aside>', f'<div class="sidebar"><h3>{say(1, 4)}</h3>{links(4)}<p>{say(5, 30)}</p></div>', f'<section class="comments"><h3>{say(1, 3)}</h3>{comments}</section>', f'<div id="comments">{comments}</div>', f'<form action="/s"><p>{say(3, 12)}</p><input></form>', f'<div class="newsletter"><p>{say(4, 20)}</p></div>', f'<div class="footer"><p>{say(3, 20)}</p></div>', f'<div class="related"><h3>{say(1, 3)}</h3>{links(4)}</div>', f'<div class="ads"><p>{say(5, 30)}</p></div>']
        page = "".join(draw.sample(before, 3)) + main + "".join(draw.sample(after, 4))
        out.append((f"<html><head><title>{say(1, 5)}</title></head><body>{page}</body></html>", frozenset(content)))
    return out


@functools.lru_cache(1)
def trained(rounds: int = 120, rate: float = 0.4, l2: float = 2e-3) -> Model:
    """Gradient ascent on the exact likelihood of the labelled pages; a node is content if a text of its subtree is."""
    sample = labelled_pages()
    pages = [Page(source) for source, _ in sample]
    f = Forest(pages, {})
    y = np.zeros(len(f.parent), bool)
    for b, p, (_, content) in zip(f.first.tolist(), pages, sample, strict=True):
        for node, text in p.blocks:
            if text in content:
                y[b + node] = True
    for level in f.levels[:0:-1]:
        np.logical_or.at(y, f.parent[level], y[level])
    child = np.flatnonzero(~f.root)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (f.edge[child], y[f.parent[child]].astype(int), y[child].astype(int)), 1)
    unary, pair = np.zeros(WIDTH), np.zeros((EDGES, 2, 2))
    sum_u, sum_p, n = np.full_like(unary, 1e-4), np.full_like(pair, 1e-4), len(y)
    for _ in range(rounds):
        p, both, _ = Model(unary, pair).marginals(f)
        g = f.x.T @ (y - p) / n - l2 * unary
        sum_u += g * g
        unary = unary + rate * g / np.sqrt(sum_u)
        told = np.zeros_like(pair)
        np.add.at(told, f.edge[child], both[child])
        g = (seen - told) / n - l2 * pair
        sum_p += g * g
        pair = pair + rate * g / np.sqrt(sum_p)
    return Model(unary, pair)


def main_text(pages: DataFrame, key: str = "page_id", source: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns in also, text and n_chars of every page."""
    names = [key, *also]
    schema = StructType([*(StructField(c, pages.schema[c].dataType) for c in names), StructField("text", StringType()), StructField("n_chars", LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        model, memo = shared.value, {}

        def step(batch: pa.RecordBatch):
            found = model.text([Page(s) for s in texts(batch, source)], memo)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*names, "text", "n_chars"])

        return step

    return in_batches(pages.select(*names, source), make, schema)
