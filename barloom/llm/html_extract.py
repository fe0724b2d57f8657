"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree. Each node is content or not; a node's potential is log-linear in its
features (tag, words of its class, id and role, length, links and punctuation of its own text), and a 2 x 2 table joins
parent and child. Sum-product messages go up and down the tree and give each node's exact marginal; text is content if
its block's marginal exceeds one half. The weights are trained by gradient ascent on the likelihood of labelled pages,
which labelled_pages() makes, markup, labels and all, from page layouts: articles among menus, headers, footers,
sidebars, notices, adverts, forms, related links and reader comments.

Defined results: null or empty html and pages without content give an empty text; script, style, head, markup and
comments never count as text; unclosed and stray tags are repaired as browsers do; an unfinished tag at the page's end
is markup; repeated rows give equal rows; a page of any length is read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(>?)|<[!?/][^>]*>?", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that make a block of their own; all others are part of the block around them.
BLOCKS = tuple(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label legend caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math head-less".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag ends open elements of these names, up to the nearest of the fences.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "body": ()}
#: Words of class, id and role that are features.
WORDS = tuple(
    "ad ads advert advertisement sponsor sponsored promo banner nav navigation navbar menu breadcrumb breadcrumbs header masthead top footer foot bottom sidebar side aside widget "
    "comment comments reply respond discussion disqus notice notices alert cookie cookies consent warning popup modal overlay newsletter subscribe signup login search form share social "
    "related recommended more popular tags meta byline copyright legal content article post story entry main body text page container wrapper row column complementary contentinfo".split()
)
TAG_ID, WORD_ID = {t: i for i, t in enumerate(BLOCKS)}, {w: len(BLOCKS) + i for i, w in enumerate(WORDS)}
NUMERIC = len(BLOCKS) + len(WORDS)
SIZE = NUMERIC + 5 + 4 + 2
SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Nodes (parent, depth, feature ids) and text pieces (block, node, text) of one page."""

    __slots__ = ("parent", "depth", "features", "pieces", "blocks", "own", "links", "points", "labels")

    def __init__(self, source: str):
        self.parent, self.depth, self.features, self.labels = [-1], [0], [[TAG_ID["html"]]], [0]
        self.own, self.links, self.points = [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.blocks = 0
        self._read(source)
        for k, f in enumerate(self.features):
            n = self.own[k]
            f.append(NUMERIC + (0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 200 else 4))
            if n:
                share = self.links[k] / n
                f.append(NUMERIC + 5 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
                f.append(NUMERIC + 9 + (self.points[k] > 0))

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the node each belongs to
        places: dict[str, list[int]] = defaultdict(list)  # of each name above the root, ascending

        def ended(k: int) -> tuple[int, int]:
            """Take the elements from place k on off the stack; how many of them were links, and heads."""
            a = head = 0
            for t, _ in stack[k:]:
                places[t].pop()
                a += t == "a"
                head += t == "head"
                self.blocks += t in TAG_ID
            del stack[k:]
            return a, head

        at, end, links = 0, len(s), 0
        skip = 0  # open elements whose text is none: head
        while at < end:
            m = TOKEN.search(s, at)
            stop = m.start() if m else end
            if stop > at and not skip:
                self._text(s[at:stop], stack[-1][1], links)
            if not m:
                return
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if not m.group(4):  # a quote that never ends: the tag goes up to the next >
                close = s.find(">", at)
                at = end if close < 0 else close + 1
                if close < 0:
                    return
            if m.group(1):
                if name == "br":
                    continue
                if name == "p" and not places["p"]:
                    self.blocks += 1
                if places[name]:
                    a, head = ended(places[name][-1])
                    links, skip = links - a, skip - head
                continue
            if name == "br":
                if not skip:
                    self.pieces.append((self.blocks, stack[-1][1], " "))
                continue
            if name in RAW:
                close = re.compile(f"</{name}(?![a-z0-9-])[^>]*(?:>|\\Z)", re.I).search(s, at)
                at = close.end() if close else end
                continue
            closing: tuple[str, ...] = ENDS.get(name, ())
            fences = FENCES.get(name, ())
            if name in CLOSES_P:
                closing, fences = (*closing, "p"), (*fences, "button", "td", "th", "table", "caption")
                if name[0] == "h" and name[1:].isdigit() and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    closing = (*closing, stack[-1][0])
            if skip and (name in TAG_ID or name == "body"):
                closing = (*closing, "head")
            if closing:
                fence = max([0, *(places[x][-1] for x in fences if places[x])])
                cut = min((places[x][k] for x in closing if (k := bisect_right(places[x], fence)) < len(places[x])), default=0)
                if cut:
                    a, head = ended(cut)
                    links, skip = links - a, skip - head
            if name in VOID:
                self.blocks += name == "hr"
                continue
            if m.group(3).endswith("/") and name not in TAG_ID:
                continue
            node = stack[-1][1]
            if name in TAG_ID:
                self.blocks += 1
                if name in ("html", "body"):  # both are the root
                    node = 0
                    self.labels[0] = max(self.labels[0], self._names(m.group(3), self.features[0]))
                else:
                    node = self._node(name, m.group(3), node)
            links += name == "a"
            skip += name == "head"
            places[name].append(len(stack))
            stack.append((name, node))

    @staticmethod
    def _names(attributes: str, f: list[int]) -> int:
        """Add the features of class, id and role; the label, or -1."""
        if not attributes:
            return -1
        for x in NAMED.findall(attributes):
            f += {WORD_ID[w] for w in SPLIT.split((x[0] or x[1] or x[2]).lower()) if w in WORD_ID}
        k = attributes.find("data-main=")
        return int(attributes[k + 10]) if k >= 0 else -1

    def _node(self, name: str, attributes: str, parent: int) -> int:
        f = [TAG_ID[name]]
        label = self._names(attributes, f)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.features.append(f)
        self.own.append(0)
        self.links.append(0)
        self.points.append(0)
        self.labels.append(self.labels[parent] if label < 0 else label)
        return len(self.parent) - 1

    def _text(self, raw: str, node: int, links: int) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append((self.blocks, node, text))
        n = len(text.strip())
        self.own[node] += n
        if links:
            self.links[node] += n
        elif n:
            self.points[node] += sum(map(text.count, ".,;!?:"))

    def text(self, content: np.ndarray) -> str:
        out: list[str] = []
        last, parts = -1, []
        for block, node, text in self.pieces:
            if not content[node]:
                continue
            if block != last and parts:
                out.append(" ".join("".join(parts).split()))
                parts = []
            last = block
            parts.append(text)
        if parts:
            out.append(" ".join("".join(parts).split()))
        return "\n".join(x for x in out if x)


class Forest:
    """The nodes of several pages, for message passing level by level."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.start = np.cumsum([0, *sizes])
        self.parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, self.start, strict=False)]) if pages else np.zeros(0, int)
        self.depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, int)
        features = [f for p in pages for f in p.features]
        self.node = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.feature = np.array([x for f in features for x in f], int)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []

    def messages(self, unary: np.ndarray, pair: np.ndarray):
        """Marginals of being content, and the pair marginals of each node with its parent."""
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.node, weights=unary[self.feature], minlength=n)
        up, sent, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            inner = local[level] + up[level]
            sent[level] = np.logaddexp(pair[:, 0] + inner[:, :1], pair[:, 1] + inner[:, 1:])
            np.add.at(up, self.parent[level], sent[level])
        for level in self.levels[1:]:
            p = self.parent[level]
            outer = local[p] + up[p] - sent[level] + down[p]
            down[level] = np.logaddexp(outer[:, :1] + pair[0], outer[:, 1:] + pair[1])
        belief = local + up + down
        marginal = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        child = np.flatnonzero(self.depth > 0)
        p = self.parent[child]
        joint = (local[p] + up[p] - sent[child] + down[p])[:, :, None] + pair[None] + (local[child] + up[child])[:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        return marginal, joint / joint.sum((1, 2), keepdims=True), child


def train(sources: list[str], steps: int = 250, rate: float = 0.1, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and the pair table, from pages whose elements carry data-main="0" or "1"."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    y = np.concatenate([p.labels for p in pages]).astype(float)
    w, pair = np.zeros(SIZE), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    child = np.flatnonzero(forest.depth > 0)
    np.add.at(seen, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    m, v = np.zeros(SIZE + 4), np.zeros(SIZE + 4)
    for t in range(1, steps + 1):
        marginal, joint, _ = forest.messages(w, pair)
        g = np.concatenate([np.bincount(forest.feature, weights=(y - marginal)[forest.node], minlength=SIZE) - ridge * len(pages) * w, (seen - joint.sum(0)).ravel()]) / len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, pair = w + step[:SIZE], pair + step[SIZE:].reshape(2, 2)
    return w, pair


def labelled_pages(n: int = 500, seed: int = 7) -> list[str]:
    """Pages of many layouts in made-up words; data-main tells which elements hold the main text."""
    r = random.Random(seed)
    syllables = "an be co de el fi ga hu in jo ka le mi no or pa qu re si ta un vo we xi yo ze".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def prose(a: int = 1, b: int = 5) -> str:
        return " ".join(words(4, 14).capitalize() + r.choice([".", ".", "!", ", " + words(2, 6) + "."]) for _ in range(r.randint(a, b)))

    def cls(*names: str) -> str:
        return r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="box {r.choice(names)}"'])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def noise(kind: str) -> str:
        if kind == "nav":
            return r.choice(["<nav data-main=0>{}</nav>", f"<div{cls('menu', 'nav', 'navbar', 'breadcrumbs')} data-main=0>{{}}</div>", "<header data-main=0>{}</header>"]).format(links(r.randint(2, 9)))
        if kind == "header":
            return f"<header{r.choice(['', cls('header', 'masthead', 'top')])} data-main=0>{r.choice(['<h1>' + words(1, 3) + '</h1>', '<p>' + words(2, 6) + '</p>', '<div>' + words(1, 4) + '</div>'])}</header>"
        if kind == "footer":
            return r.choice(["<footer data-main=0>{}</footer>", f"<div{cls('footer', 'bottom', 'copyright', 'legal')} data-main=0>{{}}</div>"]).format(r.choice(["&copy; " + prose(1, 2), "<p>" + prose(1, 3) + "</p>", links(3)]))
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'section', 'aside']))}{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')} data-main=0>{r.choice([prose(1, 2), '<p>' + prose(1, 2) + '</p>'])}</{t}>"
        if kind == "side":
            return f"<{(t := r.choice(['aside', 'div']))}{cls('sidebar', 'side', 'widget', 'related', 'popular', 'recommended')} data-main=0><h3>{words(1, 3)}</h3>{r.choice([links(4), '<p>' + prose(1, 3) + '</p>'])}</{t}>"
        if kind == "notice":
            return f"<{(t := r.choice(['div', 'section', 'aside']))}{cls('notice', 'cookie', 'consent', 'alert', 'warning', 'popup', 'newsletter', 'subscribe')} data-main=0>{r.choice(['', '<p>'])}{prose(1, 2)}</{t}>"
        if kind == "form":
            return f"<form data-main=0><label>{words(1, 3)}</label><input><p>{prose(1, 2)}</p><button>{words(1, 2)}</button></form>"
        return f"<{(t := r.choice(['div', 'section']))}{cls('comments', 'comment', 'discussion', 'respond', 'reply')} data-main=0><h3>{words(1, 2)}</h3>" + "".join(
            r.choice([f'<div class="comment"><p>{prose(1, 3)}</p></div>', f"<p>{prose(1, 3)}</p>", f'<article class="comment"><p>{prose(1, 2)}</p></article>', f"<li>{prose(1, 2)}</li>"]) for _ in range(r.randint(1, 4))) + f"</{t}>"

    kinds = ["nav", "header", "footer", "ad", "side", "notice", "form", "comments"]
    out = []
    for _ in range(n):
        block = ["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<section><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]
        body = [f"<h1>{words(2, 9)}</h1>"] if r.random() < 0.8 else []
        short = r.random() < 0.3
        for _ in range(r.randint(1, 2) if short else r.randint(1, 12)):
            form = block[min(int(r.expovariate(0.7)), len(block) - 1)]
            body.append(form.format(prose(1, 1) if short else prose() if r.random() < 0.85 else words(1, 6)))
            if r.random() < 0.15:
                body.append(f"<h2>{words(1, 5)}</h2>")
            if r.random() < 0.08:
                body.append(noise(r.choice(["ad", "notice", "side", "form"])))
        inner = "".join(body)
        if r.random() < 0.75:
            article = f"<article data-main=1>{inner}{noise('comments') if r.random() < 0.1 else ''}</article>"
        else:
            article = f"<div{cls('content', 'article', 'post', 'story', 'entry', 'text')} data-main=1>{inner}</div>"
        if r.random() < 0.3:
            article = f"<main>{article}</main>"
        if r.random() < 0.08:  # no element of its own for the main text
            article = r.choice(["<p data-main=1>{}</p>", "<p data-main=1>{}", "<pre data-main=1>{}</pre>", "<div data-main=1>{}</div>"]).format(prose(1, 6))
        before = "".join(noise(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "side"], r.randint(0, 3)))
        after = "".join(noise(k) for k in r.sample(kinds, r.randint(0, 4)))
        page = f"{before}{article}{after}"
        if r.random() < 0.2:
            page = f"<div{cls('page', 'container', 'wrapper')}>{page}</div>"
        if r.random() < 0.03:
            out.append(f"<body data-main=1>{prose(1, 4)}")
            continue
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body data-main=0>{page}</body></html>")
    return out


_model: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def model() -> tuple[np.ndarray, np.ndarray]:
    if "model" not in _model:
        _model["model"] = train(labelled_pages())
    return _model["model"]


def extract(sources: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    marginal, _, _ = forest.messages(*weights)
    content = marginal > 0.5
    return [p.text(content[a:b]) for p, a, b in zip(pages, forest.start[:-1], forest.start[1:], strict=True)]


def html_extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text in place of the html."""
    weights = model()
    rest = [c for c in pages.columns if c not in (html, name)]
    schema = StructType([*[pages.schema[c] for c in rest], StructField(name, StringType())])

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(html))
            for i in range(0, b.num_rows, 64):
                part = pa.Table.from_batches([b.slice(i, 64)]).select(rest)
                yield from part.append_column(name, pa.array(extract(col.slice(i, 64).to_pylist(), weights), pa.string())).to_batches()

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract(pages).selectExpr("page_id", "url", "text", "cast(char_length(text) as long) AS n_chars")
