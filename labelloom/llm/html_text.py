"""Main text of web pages by belief propagation on the DOM tree.

Each node (element or text) is content or boilerplate.  A node's own potential is
log-linear in features of its tag, its class and id words, its text, its links and its
place; parent and child are linked by potentials that depend on the kind of the
child.  Sum-product messages go up the tree and down again, which is exact on a
tree, and give every node's marginal.  Texts whose marginal says content are
joined in page order.

The weights climb the likelihood of labelled pages.  No labelled pages come with
the data, so the training set is made here, from page layouts with known parts
(``labelled_pages``): articles in several mark-ups, with menus, headers, footers,
sidebars, notices, adverts, forms and comments around and inside them.

Parsing takes time in proportion to the page, however deep or broken: open elements
are counted, and each node knows the nearest open element of the kinds that a start
tag may close.

Defined results: null and empty pages give an empty text; broken mark-up is read
as far as it goes (unclosed elements end with their parent, stray end tags are
ignored, ``/>`` ends any element at once, an unclosed script or style runs to the end of the
page as browsers read it, any other unclosed raw element is empty, a tag without its
end is no text); null ``url`` or ``page_id`` stay null; other columns are
ignored, whatever they are called; pages are whole, without limits; repeated rows are
answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

_TAG = re.compile(
    # quotes count only after "="; possessive, so that no tag is read twice
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no mark-up; that of xmp is text all the same.
_RAW = frozenset("script style title textarea iframe xmp noframes".split())
_CODE = frozenset("script style".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt msub msup svg object".split())
_SECTION = frozenset("html body main article section div header footer nav aside form table ul ol dl".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
#: Kinds of elements that a start tag may end, and the borders up to which it does so.
_SCOPES = [("p", "td th table button object caption html body"), ("li", "ul ol menu"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "table"), ("option", "select")]
_ENDS = {t: i for i, (tags, _) in enumerate(_SCOPES) if i for t in tags.split()}
_NEAR: dict[str, list[tuple[int, bool]]] = {}
for _i, (_tags, _borders) in enumerate(_SCOPES):
    for _t in (*_tags.split(), *_borders.split()):
        _NEAR.setdefault(_t, []).append((_i, _t in _tags.split()))


class Node:
    """An element or a text.  ``near``: for each of ``_SCOPES`` the nearest open element, this one included; ``block``: the nearest element that is not inline."""

    __slots__ = ("tag", "parent", "words", "text", "children", "size", "linked", "features", "index", "truth", "near", "block")

    def __init__(self, tag: str, parent: Node | None, words: tuple[str, ...] = (), text: str = ""):
        self.tag, self.parent, self.words, self.text = tag, parent, words, text
        self.children: list[Node] = []
        self.near: tuple[Node | None, ...] = (None,) * len(_SCOPES) if parent is None else parent.near
        self.block = self if parent is None or (tag[0] != "#" and tag not in _INLINE) else parent.block
        if tag in _NEAR:
            near = list(self.near)
            for i, own in _NEAR[tag]:
                near[i] = self if own else None
            self.near = tuple(near)
        if parent is not None:
            parent.children.append(self)


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?>", re.I)


def parse(page: str) -> Node:
    """Tree of elements and texts ("#text"); a "#break" stands for a line break."""
    root = here = Node("#root", None)
    opened: dict[str, int] = {}
    unclosed: set[str] = set()  # raw elements without any further end tag
    pos, n = 0, len(page)

    def close(x: Node) -> None:
        nonlocal here
        while here is not x.parent:
            opened[here.tag] -= 1
            here = here.parent

    while pos < n:
        m = _TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            Node("#text", here, text=html.unescape(page[pos:end]))
        if not m:
            break
        pos = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                Node("#text", here, text=m[0][9:].removesuffix("]]>"))
            continue
        if page[pos - 1] != ">":  # the page ends inside the tag
            break
        name, rest = name.lower(), m[3]
        if m[1]:
            if opened.get(name):
                x = here
                while x.tag != name:
                    x = x.parent
                close(x)
            elif name == "p":
                Node("#break", here)
            continue
        if name == "br" or name == "hr":
            Node("#break", here)
        for scope in (0 if name in _ENDS_P else None, _ENDS.get(name)):
            if scope is not None and here.near[scope] is not None:
                close(here.near[scope])
        if name in _VOID:
            continue
        words: tuple[str, ...] = ()
        if "=" in rest:
            found = [v.strip("\"'") for k, v in _ATTR.findall(rest) if k.lower() in ("class", "id", "role", "aria-label", "itemprop")]
            words = tuple(dict.fromkeys(w.lower() for v in found for w in _WORD.findall(v)))
        if name in _RAW:  # no node: what has no text says nothing about its surroundings
            if _SELF_CLOSED.search(rest):
                continue
            tail = None if name in unclosed else _end_of(name).search(page, pos)
            if name == "xmp" and tail:
                Node("#text", Node(name, here, words), text=page[pos : tail.start()])
            if tail or name in _CODE:
                pos = tail.end() if tail else n
            else:
                unclosed.add(name)
            continue
        node = Node(name, here, words)
        if _SELF_CLOSED.search(rest):
            continue
        here = node
        opened[name] = opened.get(name, 0) + 1
    return root


def flatten(root: Node) -> list[Node]:
    """Nodes in page order, parents first, with sizes of texts and links."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        x.index = len(order)
        order.append(x)
        stack.extend(reversed(x.children))
    for x in order:
        x.size, x.linked = len(x.text.strip()), 0
    for x in reversed(order):
        if x.tag == "a":
            x.linked = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.linked += x.linked
    return order


def kind(x: Node) -> str:
    return "text" if x.tag[0] == "#" else "inline" if x.tag in _INLINE else "section" if x.tag in _SECTION else "block"


def describe(x: Node) -> list[str]:
    """Feature names of a node's own potential."""
    p = x.parent
    size = min(6, int(math.log2(x.size + 1) / 1.5))
    links = 0 if not x.size else min(3, int(4 * x.linked / x.size))
    out = ["bias", "k:" + kind(x), "t:" + x.tag, f"s:{size}", f"l:{links}", f"sl:{kind(x)}{size}{links}"]
    out += ["w:" + w for w in x.words]
    if p is not None:
        out.append("p:" + p.tag)
        out.append(f"pt:{p.tag}>{x.tag}")
        if x.tag == "#text":
            out += ["pw:" + w for w in p.words]
            out.append(f"dot:{x.text.count('.') + x.text.count(',') > 0}")
    return out


class Model:
    """Weights of features and of parent-child pairs (by the child's kind), as log potentials of content."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.pair = {k: [[0.5, -0.5], [-0.5, 0.5]] for k in ("text", "inline", "block", "section")}

    def own(self, x: Node) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in x.features)

    def marginals(self, order: list[Node], pairs: bool = False):
        """Probability of content of each node (and the four pair posteriors of each child)."""
        n = len(order)
        exp, log = math.exp, math.log
        own = [self.own(x) for x in order]  # log odds of content
        table = {k: [[exp(v) for v in row] for row in t] for k, t in self.pair.items()}
        up = list(own)  # own potential and the messages of all children, as log odds
        message = [0.0] * n  # to the parent, as log odds
        for x in reversed(order):
            i = x.index
            if x.parent is not None:
                t, o = table[kind(x)], exp(max(-30.0, min(30.0, up[i])))
                message[i] = log((t[1][0] + t[1][1] * o) / (t[0][0] + t[0][1] * o))
                up[x.parent.index] += message[i]
        belief = list(up)
        for x in order:
            if x.parent is not None:
                t = table[kind(x)]
                o = exp(max(-30.0, min(30.0, belief[x.parent.index] - message[x.index])))
                belief[x.index] = up[x.index] + log((t[0][1] + t[1][1] * o) / (t[0][0] + t[1][0] * o))
        prob = [1 / (1 + exp(-max(-30.0, min(30.0, b)))) for b in belief]
        if not pairs:
            return prob
        joint = []
        for x in order:
            if x.parent is None:
                joint.append(None)
                continue
            t = table[kind(x)]
            o = exp(max(-30.0, min(30.0, belief[x.parent.index] - message[x.index])))
            c = exp(max(-30.0, min(30.0, up[x.index])))
            j = [[t[0][0], t[0][1] * c], [t[1][0] * o, t[1][1] * o * c]]
            s = sum(map(sum, j))
            joint.append([[v / s for v in row] for row in j])
        return prob, joint


def train(pages: list[str], rounds: int = 40, rate: float = 0.4) -> Model:
    """Model of labelled pages, by AdaGrad on the exact likelihood gradient.

    In a labelled page the attribute ``truth="1"`` or ``truth="0"`` gives the label of
    an element; what lies inside shares it until another one says otherwise.
    """
    model, trees = Model(), []
    for page in pages:
        order = flatten(_with_truth(page))
        for x in order:
            x.features = describe(x)
        trees.append(order)
    seen: dict[str, float] = {}
    seen_pair = {k: [[1e-3, 1e-3], [1e-3, 1e-3]] for k in model.pair}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        moves = {k: [[0.0, 0.0], [0.0, 0.0]] for k in model.pair}
        total = sum(map(len, trees))
        for order in trees:
            prob, joint = model.marginals(order, pairs=True)
            for x, p, j in zip(order, prob, joint, strict=True):
                d = x.truth - p
                for f in x.features:
                    gradient[f] = gradient.get(f, 0.0) + d
                if j is not None:
                    m = moves[kind(x)]
                    m[x.parent.truth][x.truth] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            m[a][b] -= j[a][b]
        for f, g in gradient.items():
            g = g / total - 1e-4 * model.w.get(f, 0.0)
            seen[f] = seen.get(f, 1e-9) + g * g
            model.w[f] = model.w.get(f, 0.0) + rate * g / math.sqrt(seen[f])
        for k, m in moves.items():
            for a in (0, 1):
                for b in (0, 1):
                    g = m[a][b] / total
                    seen_pair[k][a][b] += g * g
                    model.pair[k][a][b] += rate * g / math.sqrt(seen_pair[k][a][b])
    return model


def _with_truth(page: str) -> Node:
    """Tree of a labelled page: its labels travel as class words and are taken out again."""
    root = parse(re.sub(r'truth="([01])"', lambda m: f'role="truth{"yes" if m[1] == "1" else "no"}"', page))
    stack = [(root, 0)]
    while stack:
        x, y = stack.pop()
        if "truthyes" in x.words or "truthno" in x.words:
            y = int("truthyes" in x.words)
            x.words = tuple(w for w in x.words if not w.startswith("truth"))
        x.truth = y
        stack += [(c, y) for c in x.children]
    return root


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Invented pages with known parts."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = " ".join("".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b)))
        style = r.random()
        out = out.upper() if style < 0.1 else out.capitalize()
        return out + r.choice([".", ".", ".", "", "!", ", " + out[:20]]) if r.random() < 0.8 else out.replace(" ", r.choice(["*** ", "&amp;&amp; ", ", ", ". ", " | "]))

    def attr(*names: str) -> str:
        v = r.choice(names)
        return r.choice([f' class="{v}"', f' id="{v}"', f' class="{v} {r.choice(["wide", "box", "inner", "col"])}"']) if v else ""

    def links(k: int, tag: str = "li") -> str:
        inner = "".join(f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>' for _ in range(k))
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def inline(s: str) -> str:
        for _ in range(r.randint(0, 2)):
            t = r.choice(["b", "em", "i", "strong", "a href='/y'", "span", "code"])
            s = f"{s} <{t}>{words(1, 4)}</{t.split()[0]}> {words(1, 8)}"
        return s

    def paragraph() -> str:
        kind_of = r.random()
        if kind_of < 0.7:
            return f"<p>{inline(words(1, 60))}" + r.choice(["</p>", "</p>", ""])
        if kind_of < 0.76:
            return f"<p><b>{words(2, 40)}<br>"
        if kind_of < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{words(1, 8)}</h{k}>"
        if kind_of < 0.88:
            return "<ul>" + "".join(f"<li>{inline(words(2, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind_of < 0.92:
            return f"<blockquote><p>{words(5, 30)}</p></blockquote>"
        if kind_of < 0.95:
            return f"<pre>{words(3, 20)}</pre>"
        if kind_of < 0.96:
            return f"<p>{words(2, 12)} {r.choice([f'<math><mi>{words(1, 1)}</mi><mo>=</mo><mn>3</mn></math>', '<svg viewBox=0/>', f'<svg><text>{words(1, 2)}</text></svg>', f'<object data=x><span>{words(1, 4)}</span></object>'])} {words(1, 12)}</p>"
        if kind_of < 0.975:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src='a.png'><figcaption>{words(3, 10)}</figcaption></figure>"

    def advert() -> str:
        return f'<div{attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")}>{r.choice([words(2, 40), links(2, "p"), f"<p>{words(3, 40)}</p>"])}</div>'

    def form() -> str:
        return f'<form{attr("", "search", "login", "newsletter", "subscribe", "signup")}><label>{words(1, 4)}</label><input name="q">{r.choice(["", "", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>"])}<p>{words(1, 12)}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        tag = r.choice(["div", "section", "ol"])
        item = r.choice(["div", "li", "article"])
        inner = "".join(f'<{item}{attr("comment", "reply", "comment-body")}><span class="author">{words(1, 2)}</span><p>{words(3, 40)}</p></{item}>' for _ in range(r.randint(1, 4)))
        return f'<{tag}{attr("comments", "comment-list", "responses", "discussion", "disqus-thread", "replies")}><h3>{words(1, 3)}</h3>{inner}</{tag}>'

    def aside() -> str:
        tag = r.choice(["aside", "div", "aside"])
        own = attr("sidebar", "related", "widget", "side-column", "popular", "trending", "recommended", "social-share") if tag == "div" or r.random() < 0.5 else ""
        return f"<{tag}{own}><h3>{words(1, 4)}</h3>{r.choice([links(4), f'<p>{words(3, 40)}</p>', links(3) + f'<p>{words(3, 30)}</p>'])}</{tag}>"

    def notice() -> str:
        return f'<div{attr("cookie-notice", "cookie-banner", "gdpr-consent", "notice", "alert", "modal", "popup", "newsletter", "subscribe-box", "disclaimer", "paywall")}><p>{words(3, 40)}</p>{r.choice(["", f"<button>{words(1, 2)}</button>"])}</div>'

    def share() -> str:
        return f'<div{attr("share", "social", "tags", "byline-links", "breadcrumb", "breadcrumbs", "pagination", "toolbar", "meta")}>{links(3, r.choice(["li", "span"]))}</div>'

    out = []
    for _ in range(n):
        body = "".join(paragraph() for _ in range(r.randint(1, 9)))
        if r.random() < 0.15:  # a short one
            body = "".join(f"<p>{words(2, 7)}</p>" for _ in range(r.randint(1, 3)))
        if r.random() < 0.7:
            body = f"<h1>{words(1, 10)}</h1>" + body
        for part in (advert, form, share, aside, comments, notice):
            if r.random() < 0.12:
                inner = part().replace(">", ' truth="0">', 1)
                cut = body.find("<p", r.randint(0, len(body)))
                body = body[:cut] + inner + body[cut:] if cut >= 0 else body + inner
        shape = r.random()
        if shape < 0.5:
            main = f'<article truth="1"{attr("", "", "post", "entry")}>{body}</article>'
        elif shape < 0.65:
            main = f'<main truth="1">{body}</main>'
        elif shape < 0.75:
            main = f'<main truth="1"><article>{body}</article></main>'
        else:
            main = f'<div truth="1"{attr("content", "article", "post", "entry-content", "article-body", "post-content", "story", "main-content", "main", "text")}>{body}</div>'
        before = [f"<nav>{links(r.randint(2, 7))}</nav>" if r.random() < 0.6 else f'<div{attr("nav", "menu", "navbar", "navigation", "topbar")}>{links(r.randint(2, 7))}</div>']
        if r.random() < 0.4:
            before.insert(0, f'<header{attr("", "site-header", "masthead")}>{r.choice([words(1, 4), f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f"<a href=/>{words(1, 3)}</a>"])}</header>')
        elif r.random() < 0.3:
            before.insert(0, f'<div{attr("header", "site-header", "masthead", "logo")}><p>{words(1, 8)}</p></div>')
        after = []
        for part, share_of in ((advert, 0.35), (notice, 0.25), (aside, 0.35), (form, 0.2)):
            if r.random() < share_of:
                (before if r.random() < 0.5 else after).append(part())
        if r.random() < 0.3:
            after.append(comments())
        if r.random() < 0.1:
            (before if r.random() < 0.5 else after).append(r.choice([f"<noscript><p>{words(2, 15)}</p></noscript>", f"<template><p>{words(2, 15)}</p></template>"]))
        foot = r.choice([f"&copy; example &middot; {words(2, 20)}", links(3) + words(1, 10), f"<p>{words(3, 30)}</p>"])
        after.append(f"<footer>{foot}</footer>" if r.random() < 0.7 else f'<div{attr("footer", "site-footer", "copyright", "legal")}>{foot}</div>')
        inner = main if r.random() < 0.15 else "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            inner = f'<div{attr("wrapper", "page", "container", "site", "")}>{inner}</div>'
        bare = r.random() < 0.15
        out.append(inner if bare else f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{inner}</body></html>")
    return out


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def main_text(model: Model, page: str | None) -> str:
    """Joined content blocks of a page."""
    if not page:
        return ""
    order = flatten(parse(page))
    for x in order:
        x.features = describe(x)
    prob = model.marginals(order)
    blocks: list[list[str]] = []
    last = None
    for x in order:
        if x.tag == "#break":
            last = None
        if x.tag != "#text":
            continue
        b = x.block
        if b is not last:
            blocks.append([])
            last = b
        if prob[x.index] > 0.5:
            blocks[-1].append(x.text)
    return " ".join(s for s in (" ".join("".join(parts).split()) for parts in blocks) if s)


def extracted(spark: SparkSession, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, t.as_py()) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
