"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import byte_chunks, map_arrow, narrow

# HTML's element names by kind.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never a block of text.
HIDDEN = frozenset("applet audio button canvas datalist head iframe map math noembed noframes noscript object option optgroup script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements that the start of the same kind closes, within the nearest list, table or other box.
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Elements that the start of either closes.
ALIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: Words that are told as features wherever they stand in a block.
CUES = frozenset("advertisement comment comments cookie cookies copyright login menu newsletter privacy related reply rights search share sponsored subscribe terms".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    """An open element; what is told of all its ancestors is carried along, so that depth costs nothing."""

    tag: str
    names: tuple[str, ...]
    above: Node | None
    boxes: int
    box: str
    outer: str
    score: float


@dataclass(slots=True)
class Block:
    """Text between two borders of block elements, with what is needed for its features."""

    node: Node | None
    text: str
    linked: int

    @property
    def score(self) -> float:
        return self.node.score if self.node else 0.0


def _tags(html: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, whether it ends an element, name, attributes, place after) of each tag; last, the text after all tags.

    One scan forward: each place is passed a bounded number of times. A quoted value may hold `>`; a quote without its
    end counts as a plain character. Comments, declarations and an unended tag at the end of the page are left out. The
    receiver may send a place to go on from.
    """
    at, n, last = 0, len(html), {c: html.rfind(c) for c in ">\"'"}
    kept: list[str] = []
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            break
        kept.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            at = html.find(">", lt) + 1 or n
            continue
        m = _TAG.match(html, lt) if lt < last[">"] else None
        if m is None:
            if lt + 1 < n and (html[lt + 1].isascii() and html[lt + 1].isalpha() or html[lt + 1] == "/") and lt > last[">"] and html.find("<", lt + 1) < 0:
                at = n
                break
            kept.append("<")
            at = lt + 1
            continue
        i = m.end()
        while (stop := _STOP.search(html, i)) is not None and stop[0] != ">":
            i = html.find(stop[0], stop.end()) + 1 if stop.start() < last[stop[0]] else stop.end()
        if stop is None:  # the rest is one quoted value; the tag ends at its first end instead
            stop = re.compile(">").search(html, m.end())
        at = stop.end()
        to = yield "".join(kept), bool(m[1]), m[2].lower(), html[m.end() : stop.start()], at
        kept.clear()
        if to is not None:
            at = to
            yield "", False, "", "", at  # what send() gives
    yield "".join([*kept, html[at:]]), False, "", "", n


def blocks(html: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The page's leaf blocks that have text, in page order: references decoded, white space as one space, trimmed.

    Inline elements and line breaks don't part a block. Unclosed elements end with the element around them, an unended
    tag at the end of the page is dropped, and end tags without a start are ignored. Takes time in proportion to the
    page, however it is nested or broken. A block's score is the sum of its ancestors' weights.
    """
    weights = weights or {}
    out: list[Block] = []
    stack: list[Node] = []
    where: dict[str, list[int]] = {}  # places in the stack, by tag
    boxes: list[int] = []  # places of block elements
    active: dict[str, int] = {}  # features of the open elements
    parts: list[str] = []
    linked, links, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, linked))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, hidden
        if boxes and boxes[-1] >= to:
            flush()
        while len(stack) > to:
            node = stack[-1]
            where[node.tag].pop()
            for f in _told(node):
                active[f] -= 1
            links -= node.tag == "a"
            hidden -= node.tag in HIDDEN
            stack.pop()
        while boxes and boxes[-1] >= to:
            boxes.pop()

    def push(name: str, names: tuple[str, ...]) -> None:
        nonlocal links, hidden
        above = stack[-1] if stack else None
        box = name in BLOCK and name not in ("html", "body")
        node = Node(name, names, above, (above.boxes if above else 0) + box, name if box else above.box if above else "-", (above.box if above else "-") if box else above.outer if above else "-", above.score if above else 0.0)
        for f in _told(node):
            if not active.get(f):
                node.score += weights.get(f, 0.0)
            active[f] = active.get(f, 0) + 1
        where.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            boxes.append(len(stack))
        stack.append(node)
        links += name == "a"
        hidden += name in HIDDEN

    def nearest(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    tags = _tags(html)
    for text, ends, name, attributes, at in tags:
        if text and not hidden:
            text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not name:
            continue
        if ends:
            i = nearest((name,))
            if i >= 0 and (name in BLOCK or i > nearest(("td", "th", "table"))):
                pop(i)
            elif name in BLOCK:
                flush()
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if name in BLOCK:
            if boxes and stack[boxes[-1]].tag == "p":
                pop(boxes[-1])
            flush()
        if name in SELF_CLOSING:
            i = nearest(ALIKE.get(name, (name,)))
            if i > nearest(SELF_CLOSING[name]):
                pop(i)
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(html, at)
            tags.send(len(html) if end is None else html.find(">", end.start()) + 1 or len(html))
            continue
        push(name, (_names(attributes) if len(attributes) < 300 else _names.__wrapped__(attributes)) if attributes else ())
    flush()
    return out


def _told(node: Node) -> list[str]:
    return [*([f"in={node.tag}"] if node.tag not in ("html", "body") else []), *(f"name={n}" for n in dict.fromkeys(node.names))]


@lru_cache(10_000)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(w for m in _ATTR.finditer(attributes) for w in _NAME.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()))


def _step(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def ancestors(node: Node | None) -> set[str]:
    """Features of a block's ancestors: their tags, and words of their classes, ids and roles."""
    out: set[str] = set()
    while node:
        out.update(_told(node))
        node = node.above
    return out


def features(found: list[Block]) -> list[list[str]]:
    """All features of each block of a page."""
    return [[*f, *sorted(ancestors(b.node))] for b, f in zip(found, own_features(found), strict=True)]


def own_features(found: list[Block]) -> list[list[str]]:
    """The features of each block other than its ancestors: text, nearest boxes, place, and the text kinds of the blocks beside it."""
    kinds, own = [], []
    for b in found:
        words = b.text.split()
        share, n = b.linked / max(1, len(b.text)), len(words)
        ends = b.text.rstrip("\"'”»)")[-1:] in (".", "!", "?", "…", ":")
        kinds.append(f"{_step(n, (3, 8, 20, 60))}{_step(share, (0.2, 0.7))}{int(ends)}")
        capital = sum(w[0].isupper() for w in words) / n
        f = ["bias", f"words={_step(n, (2, 4, 7, 12, 20, 40, 80))}", f"links={_step(share, (0.05, 0.3, 0.6, 0.9))}", f"ends={int(ends)}", f"capital={_step(capital, (0.1, 0.3, 0.6, 0.9))}"]
        f += [f"digits={_step(sum(c.isdigit() for c in b.text) / len(b.text), (0.05, 0.2))}"]
        if "©" in b.text or "|" in b.text or "·" in b.text:
            f.append("mark")
        if n <= 40:
            f += [f"cue={w}" for w in CUES.intersection(x.strip(".,:!?…").lower() for x in words)]
        own.append(f)
    out = []
    for i, b in enumerate(found):
        near = [f"before={kinds[i - 1] if i else '-'}", f"after={kinds[i + 1] if i + 1 < len(found) else '-'}"]
        boxes = [f"own={b.node.box}", f"pair={b.node.outer}/{b.node.box}", f"deep={min(b.node.boxes, 6)}"] if b.node else ["own=-", "pair=-/-", "deep=0"]
        out.append([*own[i], *near, *boxes])
    return out


@dataclass
class Crf:
    """Weights of features for `article text` (against not) and of the four steps between labels of neighbours."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, found: list[list[str]], scores: list[float] | None = None) -> list[bool]:
        """Viterbi: the best sequence of labels; ties go to `not`. scores adds to what the features give each block."""
        (a, b), (c, d) = self.steps
        get, back, no, yes = self.weights.get, [], 0.0, 0.0
        for i, f in enumerate(found):
            s = scores[i] if scores else 0.0
            for x in f:
                s += get(x, 0.0)
            if i == 0:
                no, yes = 0.0, s
                continue
            from_no, from_yes = (no + a, no + b), (yes + c, yes + d)
            back.append((from_yes[0] > from_no[0], from_yes[1] > from_no[1]))
            no, yes = max(from_no[0], from_yes[0]), max(from_no[1], from_yes[1]) + s
        label, out = yes > no, []
        for i in range(len(found) - 1, -1, -1):
            out.append(label)
            if i:
                label = back[i - 1][label]
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 80, penalty: float = 0.02, seed: int = 0) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on the gradients of the forward-backward pass over all pages."""
    pages = [p for p in pages if p[1]]
    index: dict[str, int] = {}
    length = max(len(y) for _, y in pages)
    flat, owner, truth, real = [], [], np.zeros((len(pages), length), np.int64), np.zeros((len(pages), length), bool)
    for p, (x, y) in enumerate(pages):
        truth[p, : len(y)], real[p, : len(y)] = y, True
        for i, f in enumerate(x):
            for name in f:
                flat.append(index.setdefault(name, len(index)))
                owner.append(p * length + i)
    flat_, owner_ = np.array(flat), np.array(owner)
    w, m, v = (np.zeros(len(index) + 4) for _ in range(3))
    n = len(pages)
    for t in range(1, rounds + 1):
        s = np.zeros((n, length, 2))
        s[:, :, 1] = np.bincount(owner_, w[:-4][flat_], n * length).reshape(n, length)
        step = w[-4:].reshape(2, 2)
        up, down = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        up[:, 0] = s[:, 0]
        for i in range(1, length):
            up[:, i] = np.logaddexp(up[:, i - 1, :1] + step[0], up[:, i - 1, 1:] + step[1]) + s[:, i]
        for i in range(length - 2, -1, -1):
            after = down[:, i + 1] + s[:, i + 1]
            new = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
            down[:, i] = np.where(real[:, i + 1, None], new, 0)
        last = real.sum(1) - 1
        z = np.logaddexp(*up[np.arange(n), last].T)
        node = np.exp(up + down - z[:, None, None])[:, :, 1] * real
        g = np.zeros_like(w)
        g[:-4] = np.bincount(flat_, (truth * real - node).ravel()[owner_], len(index))
        both = real[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                edge = np.exp(up[:, :-1, a] + step[a, b] + s[:, 1:, b] + down[:, 1:, b] - z[:, None]) * both
                g[-4 + 2 * a + b] = (((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() - edge.sum())
        g = g / n - penalty * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf({k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-3}, ((float(w[-4]), float(w[-3])), (float(w[-2]), float(w[-1]))))


class _Maker:
    """Labelled pages: invented prose in page layouts of many kinds, with what each block is."""

    ARTICLE = ["article", "div class=article-body", "div class='post content'", "main", "div id=content", "section class=story", "div class=entry-content", "main role=main", "div itemprop=articleBody class=text", "div class=post"]
    NAV = ["nav", "div class=menu", "div id=nav", "ul class=navigation", "div class='breadcrumb links'", "div role=navigation", "div class=navbar"]
    HEAD = ["header", "div class=header", "div id=masthead", "div class='site-header top'", "div role=banner"]
    FOOT = ["footer", "div class=footer", "div id=footer", "div class='site-footer bottom'", "div role=contentinfo"]
    SIDE = ["aside", "div class=sidebar", "div id=sidebar", "section class='related widget'", "div class='recommended teaser'", "div role=complementary"]
    AD = ["div class=ad", "div class=advert", "aside class=sponsored", "div id=ad-1", "div class='promo banner'", "div class=ads", "section class=advertisement", "ins class=adsbygoogle"]
    NOTICE = ["div class=cookie-notice", "div id=notice", "div class='consent popup'", "div class=alert", "section class='newsletter subscribe'", "div role=alert", "div class=gdpr", "div role=dialog class=modal"]
    FORM = ["form", "form class=search", "div class=login><form", "form id=subscribe", "form class=comment-form"]
    COMMENTS = ["section class=comments", "div id=comments", "div class='comment-list'", "div class=discussion", "ol class='commentlist'", "div class=user-comments", "div class='replies responses'"]

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = [a + b for a in "bcdfghjklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "é", "ü", "st")]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        noise = self.r.random()
        if noise < 0.05:
            words = [w + self.r.choice(("###", "***", "!!", "%%%", "&amp;&amp;&amp;")) for w in words]
        return (" ".join(words)).capitalize() + self.r.choice((".", ".", ".", "?", "!", ","))

    def prose(self) -> str:
        n = self.r.choice((1, 1, 2, 3, 5, 8))
        return " ".join(self.sentence() for _ in range(n))

    def link(self, n: int) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(n))}</a>'

    def wrap(self, opening: str, inside: str) -> str:
        tags = [t.split()[0] for t in opening.split("><")]
        return "<" + opening.replace("><", "><") + ">" + inside + "".join(f"</{t}>" for t in reversed(tags))

    def boxes(self, kind: list[str], inside: str) -> list[tuple[str, bool]]:
        return [(self.wrap(self.r.choice(kind), inside), False)]

    def boiler(self, what: str) -> list[tuple[str, bool]]:
        r = self.r
        links = "".join(f"<li>{self.link(r.randint(1, 3))}</li>" for _ in range(r.randint(2, 7)))
        text = lambda: r.choice((f"<p>{self.prose()}</p>", self.sentence(), f"<h3>{self.word().title()}</h3><p>{self.prose()}</p>"))
        if what == "nav":
            return self.boxes(self.NAV, f"<ul>{links}</ul>" if r.random() < 0.7 else " | ".join(self.link(1) for _ in range(5)))
        if what == "head":
            return self.boxes(self.HEAD, f"<{(t := r.choice(('h1', 'div', 'p', 'span')))}>{self.sentence(1, 6)}</{t}>" + (f"<ul>{links}</ul>" if r.random() < 0.5 else ""))
        if what == "foot":
            return self.boxes(self.FOOT, f"&copy; {self.word()}.example &middot; {self.sentence()}" if r.random() < 0.6 else f"<p>&copy; 2020 {self.sentence(2, 9)} All rights reserved.</p><ul>{links}</ul>")
        if what == "side":
            return self.boxes(self.SIDE, f"<h3>{self.sentence(1, 3)}</h3><ul>{links}</ul>" if r.random() < 0.5 else text())
        if what == "ad":
            return self.boxes(self.AD, self.sentence(3, 14) if r.random() < 0.6 else text())
        if what == "notice":
            return self.boxes(self.NOTICE, r.choice(("", "We use cookies. ", "Subscribe to our newsletter. ", "Privacy: ")) + self.sentence(3, 16))
        if what == "form":
            return self.boxes(self.FORM, f"<label>{self.sentence(1, 4)}</label><input><p>{self.sentence(1, 8)}</p><button>{self.word()}</button>")
        one = lambda: self.wrap(r.choice(("div class=comment", "li", "p", "article class=comment", "div")), f"<b>{self.word()}</b> <p>{self.prose()}</p>")
        return self.boxes(self.COMMENTS, (f"<h3>{r.randint(1, 40)} Comments</h3>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 5))))

    def page(self) -> tuple[str, list[bool]]:
        """A page and the label of each of its blocks; labels come from parsing the parts one by one, marked by a word."""
        r = self.r
        body: list[tuple[str, bool]] = []
        if r.random() < 0.85:
            body.append((f"<{(t := r.choice(('h1', 'h1', 'h2')))}>{self.sentence(2, 12)}</{t}>", True))
        for _ in range(r.choice((1, 2, 4, 7, 12))):
            k = r.random()
            if k < 0.68:
                body.append((f"<p>{self.prose()}</p>", True))
            elif k < 0.74:
                body.append((f"<p><b>{self.sentence()}<br>", True))
            elif k < 0.79:
                body.append((f"<{(t := r.choice(('h2', 'h3')))}>{self.sentence(1, 7)}</{t}><p>{self.prose()}</p>", True))
            elif k < 0.83:
                body.append((f"<ul><li>{self.sentence()}<li>{self.sentence()}</ul>", True))
            elif k < 0.87:
                body.append((f"<blockquote><p>{self.prose()}</p></blockquote>", True))
            elif k < 0.9:
                body.append((f"<p>{self.prose()} {self.link(2)} {self.sentence()}</p>", True))
            else:
                body += self.boiler(r.choice(("ad", "ad", "notice", "form", "side")))
        top = [x for what in ("notice", "head", "nav", "ad", "form") if r.random() < 0.55 for x in self.boiler(what)]
        if r.random() < 0.3:
            r.shuffle(top)
        inner = [x for what in ("comments",) if r.random() < 0.12 for x in self.boiler(what)]
        low = [x for what in ("ad", "side", "comments", "form", "nav", "foot", "notice") if r.random() < 0.45 for x in self.boiler(what)]
        k = r.random()
        frame = r.choice(self.ARTICLE) if k < 0.76 else "div" if k < 0.82 else f"div class={self.word()}" if k < 0.88 else "table><tr><td" if k < 0.94 else ""
        if frame and r.random() < 0.3:
            frame = r.choice(("div id=page", "div class=wrapper", "div class=container", "main")) + "><" + frame
        if frame.endswith("td") and r.random() < 0.7:  # a layout table with a column of links, and perhaps rows above and below
            inner.append(("</td><td>" + "".join(self.wrap(r.choice(("div", "li", "p")), self.link(r.randint(1, 3))) for _ in range(r.randint(2, 7))), False))
            if r.random() < 0.5:
                inner.append((f"</td></tr><tr><td>{self.wrap(r.choice(('font size=1', 'small', 'span', 'p')), self.sentence(2, 8))}", False))
            if r.random() < 0.5:
                inner, body = [], [(inner[0][0].removeprefix("</td><td>") + "</td><td>", False), *body, *inner[1:]]
        if not frame and r.random() < 0.5:
            inner.append((f"<hr>{self.wrap(r.choice(('address', 'small', 'p', 'div')), self.sentence(2, 8))}", False))
        marked = lambda parts: "".join(p if not ok else re.sub(r">([^<]*[^<\s])", lambda m: ">\x01" + m[1], ">" + p if not p.startswith("<") else p) for p, ok in parts)
        page = f'<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{margin:0}}</style></head><body>{marked(top)}{self.wrap(frame, marked(body) + marked(inner)) if frame else marked(body) + marked(inner)}{marked(low)}</body></html>'
        labels = ["\x01" in b.text for b in blocks(page)]
        return page.replace("\x01", ""), labels


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[bool]]]:
    """Pages made from the seed, with for each of their blocks whether it is article text."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(count)]


@lru_cache(2)
def model(pages: int = 700, seed: int = 0) -> Crf:
    """The field trained on labelled pages; the same for the same arguments, and independent of the table it is used on."""
    return fit([(features(blocks(p)), y) for p, y in labelled_pages(pages, seed)])


def main_text(html: str | None, crf: Crf) -> str:
    found = blocks(html or "", crf.weights)
    return "\n\n".join(b.text for b, keep in zip(found, crf.decode(own_features(found), [b.score for b in found]), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), crf: Crf | None = None) -> DataFrame:
    """The columns named in keep, text and n_chars for every page, from its whole html; one pass without a shuffle.

    A null or empty html, or one without article text, gives an empty text. Broken markup never fails. Repeated rows are
    extracted each; empty tables stay empty; other columns are left out.
    """
    sent = pages.sparkSession.sparkContext.broadcast(crf or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "__html", 4_000_000):
            text = [main_text(h, sent.value) for h in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "text", "n_chars"])

    rows = narrow(pages, **{k: k for k in keep}, __html=F.col(f"`{html_col}`").cast("string"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(rows, run, f"{kinds}, text string, n_chars long")
