"""Main-text extraction from web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

The trees are trained here, on pages that `example_page` writes from rules in many layouts with known parts, so the
model is the same wherever it runs and learns nothing of the pages it is applied to.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script style noscript template iframe svg object canvas head".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub"
    " sup time tt u var wbr".split()
)
#: An opening tag on the left ends open elements on the right, up to an element of STOPS.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table td th body article section main div nav aside form select html".split())
#: What opening tags end: an open p, for some tags others too. By which of these an opening tag goes, and for each tag that
#: matters, whether an element of it is ended (True), guards what is outside it (False) or neither (None), by each of them.
ENDED = [frozenset("p")] + [frozenset(x) | {"p"} for x in ({"li"}, {"dt", "dd"}, {"tr", "td", "th"}, {"td", "th"}, {"option"})]
ENDS_BY = {t: ENDED.index(frozenset(x) | {"p"}) for t, x in ENDS.items()}
ROLE = {t: tuple(True if t in x else False if t in STOPS else None for x in ENDED) for t in STOPS.union(*ENDED)}
TAGS = (
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table div section article main nav header footer aside form button label"
    " select option textarea fieldset figure figcaption blockquote pre address details summary dialog menu html body"
).split()
#: Words in class, id and role that often name a part; each is a feature of its own.
NAMES = (
    "article content post main story entry body text prose nav menu navbar breadcrumb header masthead footer bottom sidebar side"
    " aside rail widget ad ads advert advertisement sponsor promo banner cookie consent notice alert popup modal overlay comment"
    " comments reply replies discussion respond form search login signup subscribe newsletter share social related recommended"
    " tags meta byline copyright legal pagination pager toolbar skip disclaimer gdpr"
).split()

_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_NAME_AT = {t: i for i, t in enumerate(NAMES)}
_PIECES = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(" + "|".join(SKIPPED) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-z](?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*(?:>|\Z)"
)
_TAG = re.compile(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*)")
_ATTRIBUTE = re.compile(r"(?is)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_BODY = re.compile(r"(?i)<body\b")


class Element:
    """A block-level element: what it holds in order (strings and elements) and what its tag says.

    ended holds, for each of ENDED, the nearest open element that it ends, this one or one around it.
    """

    __slots__ = ("at", "depth", "ended", "holds", "names", "parent", "tag")

    def __init__(self, tag: str, names: list[str], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        self.holds: list = []
        self.at = -1
        self.ended: tuple[Element | None, ...] = parent.ended if parent else (None,) * len(ENDED)
        if parent and (role := ROLE.get(tag)):
            self.ended = tuple(self if r else None if r is False else x for r, x in zip(role, self.ended, strict=True))


LINK, END = "\x00", "\x01"  # around a link's text while a page is parsed


def parse(page: str) -> Element:
    """The block-level elements of a page, however broken its markup; inline tags vanish, links are marked."""
    if (body := _BODY.search(page)) is not None:  # an unclosed head must not swallow the page
        page = page[body.start() :]
    page = page.replace(LINK, " ").replace(END, " ")
    root = node = Element("html", [], None)
    at, skip_names, is_open = 0, [], Counter()

    def outside(up: Element) -> Element:
        """The element around `up`; `up` and all in it are closed, each once."""
        inner = node
        while inner is not up.parent:
            is_open[inner.tag] -= 1
            inner = inner.parent
        return inner

    for m in _PIECES.finditer(page):
        if m.start() > at:
            node.holds.append(page[at : m.start()])
        at = m.end()
        if m.group(1) or m.group()[1] in "!?":
            node.holds.append(" ")
            continue
        closing, tag, rest = _TAG.match(m.group()).groups()
        tag = tag.lower()
        if tag in INLINE:
            node.holds.append((END if closing else LINK) if tag == "a" else " " if tag in ("br", "img") else "")
            continue
        if closing:
            if is_open[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = outside(up)
            continue
        if tag in ("html", "body"):
            continue
        if (up := node.ended[ENDS_BY.get(tag, 0)]) is not None:
            node = outside(up)
        names = skip_names
        if "=" in rest and (found := _ATTRIBUTE.findall(rest)):
            names = [w.lower() for x in found for w in _WORD.findall(" ".join(x))]
        if tag in VOID:
            node.holds.append(" ")
            continue
        child = Element(tag, names, node)
        is_open[tag] += 1
        node.holds.append(child)
        node = child
    if at < len(page):
        node.holds.append(page[at:])
    return root


def elements(root: Element) -> list[Element]:
    """All elements in page order, numbered."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        e.at = len(out)
        out.append(e)
        stack.extend(x for x in reversed(e.holds) if isinstance(x, Element))
    return out


def _shown(raw: list[str]) -> tuple[str, int]:
    """A block's text, and how many of its characters are in links."""
    text = "".join(raw)
    if "&" in text:
        text = html.unescape(text)
    linked = 0
    if LINK in text or END in text:
        parts = text.split(LINK)
        linked = sum(len(p.split(END)[0].strip()) for p in parts[1:])
        text = text.replace(LINK, "").replace(END, "")
    return " ".join(text.split()), linked


def blocks(root: Element) -> list[tuple[Element, str, int]]:
    """(element, text, characters in links) of each run of inline content, in page order."""
    out: list[tuple[Element, str, int]] = []
    stack: list[tuple[Element, int]] = [(root, 0)]
    while stack:
        e, i = stack.pop()
        raw = []
        while i < len(e.holds) and isinstance(e.holds[i], str):
            raw.append(e.holds[i])
            i += 1
        if raw:
            text, linked = _shown(raw)
            if text:
                out.append((e, text, linked))
        if i < len(e.holds):
            stack.append((e, i + 1))
            stack.append((e.holds[i], 0))
    return out


#: Elements that are scored at once (a row is some 190 numbers of four bytes).
NODES = 20_000
#: Features after the tags' and names' own, the parent's tag and the names of all ancestors.
MEASURES = 12


def measures(found: list[Element], parts: list[tuple[Element, str, int]]) -> np.ndarray:
    """Depth, siblings and the density of the subtree, a row for each element of a page."""
    n = len(found)
    m = np.zeros((n, MEASURES), np.float32)
    chars, linked, marks, runs, below = (np.zeros(n) for _ in range(5))
    direct = np.zeros(n)
    for e, text, links in parts:
        chars[e.at] += len(text)
        linked[e.at] += links
        marks[e.at] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        runs[e.at] += 1
        direct[e.at] += len(text)
    for e in reversed(found):
        if e.parent is not None:
            p = e.parent.at
            chars[p] += chars[e.at]
            linked[p] += linked[e.at]
            marks[p] += marks[e.at]
            runs[p] += runs[e.at]
            below[p] += below[e.at] + 1
    for e in found:
        children = [x for x in e.holds if isinstance(x, Element)]
        alike = Counter(x.tag for x in children)
        for k, c in enumerate(children):
            m[c.at, 6] = len(children)
            m[c.at, 7] = k / len(children)
            m[c.at, 8] = alike[c.tag]
        m[e.at, 5] = min(e.depth, 30)
    total = max(1.0, chars[0])
    m[:, 0] = np.log1p(chars)
    m[:, 1] = linked / np.maximum(1, chars)
    m[:, 2] = 100 * marks / np.maximum(1, chars)
    m[:, 3] = np.log1p(chars / np.maximum(1, runs))
    m[:, 4] = np.log1p(below)
    m[:, 9] = chars / total
    m[:, 10] = np.log1p(direct)
    m[:, 11] = np.log1p(chars / (1 + below))
    return m


def features(found: list[Element], measured: np.ndarray) -> np.ndarray:
    """A row for each element: its tag, its parent's, its attribute tokens, and what was measured."""
    tags, names = len(TAGS), len(NAMES)
    own = np.zeros((len(found), 2 * tags + names + MEASURES), np.float32)
    for i, e in enumerate(found):
        if (t := _TAG_AT.get(e.tag)) is not None:
            own[i, t] = 1
        for w in e.names:
            if (t := _NAME_AT.get(w)) is not None:
                own[i, 2 * tags + t] = 1
        if e.parent is not None and (t := _TAG_AT.get(e.parent.tag)) is not None:
            own[i, tags + t] = 1
    own[:, 2 * tags + names :] = measured
    return own


class Trees:
    """Gradient-boosted trees for a yes-or-no label, over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.bounds: list[np.ndarray] = []
        self.trees: list[list[tuple[int, float, np.ndarray]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        self.bounds = [b if len(b) else np.zeros(1) for b in self.bounds]
        binned = np.stack([np.searchsorted(self.bounds[j], x[:, j], "left") for j in range(width)], axis=1)
        used = [j for j in range(width) if binned[:, j].max() > binned[:, j].min()]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            place = np.zeros(n, np.int64)  # in the current level
            levels = []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-9)
                split = np.full(nodes, -1)
                cut = np.full(nodes, np.inf)
                for j in used:
                    b = len(self.bounds[j]) + 1
                    at = place * b + binned[:, j]
                    g = np.bincount(at, gradient, nodes * b).reshape(nodes, b).cumsum(axis=1)
                    h = np.bincount(at, weight, nodes * b).reshape(nodes, b).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain[:, :-1].argmax(axis=1)
                    top = gain[np.arange(nodes), k]
                    better = top > best
                    best[better], split[better], cut[better] = top[better], j, k[better]
                levels.append((split, cut))
                own = np.where(split[place] >= 0, split[place], 0)
                place = place * 2 + ((binned[np.arange(n), own] > cut[place]) & (split[place] >= 0))
            leaves = 1 << self.depth
            g, h = np.bincount(place, gradient, leaves), np.bincount(place, weight, leaves)
            value = self.rate * g / (h + self.ridge)
            score += value[place]
            real = [(s, np.array([self.bounds[j][int(c)] if j >= 0 else np.inf for j, c in zip(s, k, strict=True)])) for s, k in levels]
            self.trees.append((real, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for levels, value in self.trees:
            place = np.zeros(len(x), np.int64)
            for split, cut in levels:
                own = split[place]
                place = place * 2 + ((own >= 0) & (x[rows, np.maximum(own, 0)] > cut[place]))
            out += value[place]
        return out


def decode(found: list[Element], odds: np.ndarray) -> np.ndarray:
    """Which elements to keep, from the page down: nothing is kept in something dropped.

    The trees are trained on elements whose parents are main text, so each choice supposes those above it.
    """
    out = np.zeros(len(found), bool)
    for e in found:
        out[e.at] = e.parent is None or (out[e.parent.at] and odds[e.at] > 0)
    return out


def _prose(r: random.Random, words: int) -> str:
    out = []
    for i in range(words):
        w = "".join(r.choice("aeinorst") for _ in range(r.randint(2, 9)))
        out.append(w.capitalize() if not out or out[-1].endswith(".") else w)
        if i and r.random() < 0.12:
            out[-1] += r.choice([".", ",", ".", "?"])
    return " ".join(out) + "."


def example_page(seed: int) -> tuple[str, set[str]]:
    """A page from rules, and the ids of the elements that hold its main text."""
    r = random.Random(seed)
    good: set[str] = set()
    count = iter(range(10**6))

    def tag(name: str, inner: str, names: str = "", main: bool = False) -> str:
        key = f"n{next(count)}q"
        if main:
            good.add(key)
        return f'<{name} id="{key}"' + (f' class="{names}"' if names else "") + f">{inner}</{name}>"

    def links(n: int) -> str:
        return tag("ul", "".join(tag("li", f'<a href="/x">{_prose(r, r.randint(1, 3))[:-1]}</a>') for _ in range(n)))

    def part(names: list[str], plain: str, inner: str) -> str:
        """By its own element, or as a div that only its class names."""
        return tag(plain, inner, r.choice(["", r.choice(names)])) if r.random() < 0.5 else tag("div", inner, r.choice(names))

    def paragraphs(low: int, high: int, main: bool) -> str:
        out = ""
        for _ in range(r.randint(low, high)):
            words = r.choice([1, 3, 8, 30, 80, 150])
            inner = _prose(r, words)
            if r.random() < 0.2:
                inner = f"<b>{inner}<br>"
            if r.random() < 0.1:
                inner += f' <a href="/y">{_prose(r, 2)}</a>'
            kind = r.choice(["p"] * 8 + ["h2", "blockquote", "pre", "h3"])
            out += tag(kind, inner, "", main)
            if r.random() < 0.08:
                out += tag("ul", "".join(tag("li", _prose(r, r.randint(3, 20)), "", main) for _ in range(r.randint(2, 5))), "", main)
            if r.random() < 0.05:
                cells = "".join(tag("td", _prose(r, 2), "", main) for _ in range(3))
                out += tag("table", tag("tr", cells, "", main), "", main)
        return out

    notice = lambda names, plain, low=3, high=40: part(names, plain, r.choice(["", ""]) + (_prose(r, r.randint(low, high)) if r.random() < 0.5 else tag("p", _prose(r, r.randint(low, high)))))
    edges = {
        "nav": lambda: part(["nav", "menu", "navbar", "main-menu"], "nav", links(r.randint(2, 8))),
        "header": lambda: part(["header", "site-header", "masthead", "banner"], "header", tag("p", _prose(r, r.randint(1, 12)))),
        "ad": lambda: tag(r.choice(["div", "aside", "section"]), _prose(r, r.randint(3, 40)), r.choice(["ad", "ads", "advert", "advertisement", "sponsor", "promo"])),
        "cookie": lambda: tag(r.choice(["div", "section", "dialog"]), _prose(r, r.randint(5, 30)) + tag("button", "Ok"), r.choice(["cookie-notice", "cookie consent", "notice", "banner", "alert", "popup", "gdpr", "overlay modal"])),
        "form": lambda: tag("form", tag("label", _prose(r, 2)) + "<input name=q>" + tag("button", _prose(r, 1)), r.choice(["", "search", "login", "newsletter", "subscribe", "signup"])),
        "side": lambda: part(["sidebar", "side", "rail", "widget", "related", "recommended"], "aside", tag("h3", _prose(r, 2)) + (links(r.randint(2, 6)) if r.random() < 0.6 else tag("p", _prose(r, r.randint(5, 40))))),
        "share": lambda: tag("div", links(3), r.choice(["share", "social", "tags", "pagination", "breadcrumb", "toolbar"])),
    }
    after = {
        "footer": lambda: notice(["footer", "site-footer", "bottom", "copyright", "legal"], "footer"),
        "comments": lambda: tag(
            r.choice(["div", "section", "ol", "ul", "aside"]),
            "".join(tag(r.choice(["div", "li", "article"]), tag("p", _prose(r, r.randint(3, 60))), r.choice(["comment", "reply", ""])) for _ in range(r.randint(1, 6))),
            r.choice(["comments", "discussion", "comment-list", "respond replies"]),
        ),
    }
    title = tag("h1", _prose(r, r.randint(1, 9)), "", True)
    inside = [paragraphs(1, 5, True) for _ in range(r.randint(1, 3))]
    if r.random() < 0.25:
        inside = [tag("p", _prose(r, r.choice([1, 2, 3, 6, 12])), "", True)]
    for _ in range(r.choice([0, 0, 1, 2])):
        inside.insert(r.randint(0, len(inside)), r.choice([edges["ad"], edges["side"], edges["share"], edges["form"], edges["cookie"], edges["nav"], after["footer"]])())
    text = title + "".join(inside)
    if r.random() < 0.2:
        text += after["comments"]()
    shell = r.choice(["article", "article", "article", "main", "div", "section"])
    names = r.choice(["", "content", "post", "story entry", "article-body", "main prose"]) if shell != "div" else r.choice(["content", "post", "article", "story", "entry text"])
    page = tag(shell, text, names, True)
    if r.random() < 0.3:
        page = tag(r.choice(["div", "main", "section"]), page + (edges["side"]() if r.random() < 0.5 else ""), r.choice(["", "wrapper", "page", "content"]), True)
    front = [edges[k]() for k in r.sample(sorted(edges), r.randint(1, 5))]
    back = [after[k]() for k in ("comments", "footer") if r.random() < 0.7]
    if r.random() < 0.5:
        back.insert(0, edges["side"]())
    return "<html><body>" + "".join(front) + page + "".join(back) + "</body></html>", good


#: Pages that the trees are trained on.
EXAMPLES = 1000


@lru_cache(maxsize=1)
def model() -> Trees:
    xs, ys = [], []
    for seed in range(EXAMPLES):
        page, good = example_page(seed)
        root = parse(page)
        found = elements(root)
        keys = [None, *re.findall(r'id="(n\d+q)"', page)]  # elements stand in page order, as their tags do
        for e in found:
            e.names = [w for w in e.names if w not in ("n", "q")]
        main = np.array([k in good for k in keys])
        main[0] = True
        asked = np.array([e.parent is not None and main[e.parent.at] for e in found])
        xs.append(features(found, measures(found, blocks(root)))[asked])
        ys.append(main[asked].astype(float))
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def main_text(pages: list[str | None], trees: Trees, nodes: int = NODES) -> list[str]:
    """The main text of each page. Pages are held parsed until they have `nodes` elements, and so many are scored at once."""
    out: list[str] = []
    held: list[tuple[list[Element], list[tuple[Element, str, int]]]] = []
    count = 0

    def finish() -> None:
        every = [e for found, _ in held for e in found]
        measured = np.concatenate([measures(found, parts) for found, parts in held])
        steps = range(0, len(every), nodes)
        odds = np.concatenate([trees.score(features(every[i : i + nodes], measured[i : i + nodes])) for i in steps])
        at = 0
        for found, parts in held:
            own = odds[at : at + len(found)].copy()
            at += len(found)
            own[0] = 0.0
            kept = decode(found, own)
            out.append("\n".join(text for e, text, _ in parts if kept[e.at]))
        held.clear()

    for page in pages:
        root = parse(page or "")
        held.append((elements(root), blocks(root)))
        count += len(held[-1][0])
        if count >= nodes:
            finish()
            count = 0
    if held:
        finish()
    return out


def extract(pages: DataFrame, group: int = 200) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page, from its whole html.

    Null and empty pages and pages without main text have an empty text. Repeated rows are extracted each, an empty
    table gives no rows, extra columns are not read. Very long pages are parsed in one pass and scored NODES elements at
    a time. The trees are trained on the driver and broadcast (some hundred numbers a tree); pages are taken `group` at a
    time, without a shuffle.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                texts = main_text(part.column(2).to_pylist(), shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
