"""Main text of web pages by the maximum-scoring subsequence.

A page is read once into a sequence of words, tags and names, a name being a class, id or role. Words score positive and
tags negative, and a name by its words, with weights learnt from labelled pages; the last word of a name that isn't
about layout counts double, as "work" in related-work and "comments" in post-comments. An element whose name scores
negative, or that by its tag holds no article text (a menu, a form, a script), is set aside and leaves its negative token.
One linear scan finds the contiguous region of the greatest sum. The region then grows to the blocks of its own
container, so that short first and last paragraphs stay.

Defined results: a null or empty page, or one without words, has the text "" and 0 characters; character references
are decoded; white space in a block becomes one space; blocks are joined by one line feed; broken or cut-off markup
is read as far as it goes: what is never closed, but script, style, title and textarea, hides nothing; time grows in
proportion to a page's length, however deep it nests; repeated rows give repeated results; other columns than page_id,
url and html are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cols

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?>"[^"]*"|'[^']*'|[^>"'])*+)>|([^>]*)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Element names.
RAW = frozenset("script style title textarea noscript iframe xmp template svg math".split())
DROPPED = frozenset("script style title textarea noscript iframe xmp template svg math head nav footer aside form button select dialog menu object canvas audio video".split())
#: Of these, what hides the rest of a page where it isn't closed.
UNSEEN = frozenset("script style title textarea".split())
#: What may stand in head; anything else closes it.
IN_HEAD = frozenset("head title base link meta style script noscript template basefont bgsound noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br-block center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
CONTAINER = frozenset("article main section div td body html blockquote figure table ul ol dl details fieldset header".split())
LISTED = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
# Words in names of what is no article text, of what is, and of layout, which say nothing.
BAD = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar search pagination pager skip copyright legal complementary contentinfo dialog".split())
GOOD = frozenset("article content main post entry story body text".split())
LAYOUT = frozenset("area articles bar block bottom box button buttons center column container element form global group holder icon icons inner item items js left link links list outer page panel position posts primary region right row secondary section site slot stories top unit wrap wrapper zone".split())
ABOUT = frozenset("has with without no layout free".split())
#: Of a word that the labelled pages lack.
UNKNOWN = 0.6
WALL = -50.0

_MAIN = "<!--main-->", "<!--/main-->"
#: Labelled pages: the main region stands between the two marks.
LABELLED = (
    "<html><body><div><a>Home</a> <a>News</a> <a>Sport</a></div><!--main--><h1>A title of five words</h1><p>Some words make a paragraph that has a <a>link</a> and goes on for a while.</p><p>Another one, <b>bold</b> and <i>set apart</i>, with as many words as the last.</p><p>Short.</p><!--/main--><div><span>12</span><span>likes</span></div><div><a>More</a></div></body></html>",
    "<html><body><table><tr><td><a>One</a></td><td><a>Two</a></td></tr></table><div><!--main--><p>The first paragraph of an old page is long enough to read.<br>It has two lines, and the second says as much.</p><ul><li>A listed point that matters</li><li>Another point of the list</li></ul><p>And a last word on it.</p><!--/main--></div><ul><li><a>Prev</a></li><li><a>Next</a></li></ul><div>All rights</div></body></html>",
    "<html><body><div><ul><li><a>A</a></li><li><a>B</a></li><li><a>C</a></li></ul></div><div><!--main--><h2>Heading of it</h2><blockquote>Words that someone else had said some years before.</blockquote><p>Then the page's own words follow in a long sentence, and more of them.</p><!--/main--></div><div><img><a>Buy</a><img><a>Now</a></div></body></html>",
)


#: Labelled names: those words in what stands outside and inside the marks.
_ELEMENTS = ["".join(f'<div class="{w}"></div>' for w in sorted(x)) for x in (BAD | LAYOUT, GOOD | LAYOUT)]
LABELLED_NAMES = (f"<html><body>{_ELEMENTS[0]}<!--main-->{_ELEMENTS[1]}<!--/main--></body></html>",)


@dataclass
class Weights:
    tokens: dict[str, float]
    names: dict[str, float]

    def name(self, words: list[str]) -> float:
        """The score of a name; of one about what stands beside an element 0."""
        if not ABOUT.isdisjoint(words):
            return 0.0
        each = [self.names.get(w, UNKNOWN if len(w) > 2 else 0.0) for w in words]
        return sum(each) + next((x for x in reversed(each) if x), 0.0)


@dataclass
class Tree:
    """Containers by number, in the order in which they open: their name or "good", the one around each, and the last one in each."""

    names: list[str] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def holds(self, outer: int, inner: int) -> bool:
        return outer <= inner <= self.last[outer]


@dataclass
class Block:
    tag: str
    inside: int  # the innermost container around it, or -1
    words: int = 0
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def _names(attrs: str) -> list[list[str]]:
    """The words of each class, id and role; "modal" for what is hidden."""
    said: list[list[str]] = []
    for name, a, b, c in _NAMED.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for one in (a or b or c).split():
                said.append([x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if x])
        elif name.lower() == "hidden" or (a or b or c).lower() == "true":
            said.append(["modal"])
    return said


def read(html: str, weights: Weights | None = None) -> tuple[list[tuple[str, float, int]], list[Block], Tree]:
    """Tokens (kind, amount, block), blocks of text, and the containers. Without weights nothing is set aside for its name, and names' words are tokens."""
    tokens: list[tuple[str, float, int]] = []
    blocks: list[Block] = []
    tree = Tree()
    stack: list[tuple[str, int]] = []  # open elements; the number of a container, else -1
    inside: list[int] = []  # the containers among them
    is_open: Counter = Counter()
    endless: set[str] = set()
    drop_at = -1  # depth of the element that is set aside
    fresh, block_tag, pos, n = True, "body", 0, len(html)

    def text(s: str) -> None:
        nonlocal fresh
        s = unescape(s) if "&" in s else s
        words = len(s.split())
        if words and fresh:
            blocks.append(Block(block_tag, inside[-1] if inside else -1))
            fresh = False
        if not fresh:
            blocks[-1].parts.append(s)
            if words:
                blocks[-1].words += words
                blocks[-1].linked += words if is_open["a"] else 0
                tokens.append(("word", words, len(blocks) - 1))

    def pop(to: int) -> None:
        nonlocal drop_at
        for name, k in reversed(stack[to:]):
            is_open[name] -= 1
            if k >= 0:
                tree.last[inside.pop()] = len(tree.names) - 1
        del stack[to:]
        if drop_at >= len(stack):
            drop_at = -1

    while pos < n:
        m = _TOKEN.search(html, pos)
        if (m.start() if m else n) > pos and drop_at < 0:
            text(html[pos : m.start() if m else n])
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if m[0] in _MAIN:
                tokens.append((m[0], 1, -1))
            continue
        name, close = m[2].lower(), bool(m[1])
        attrs = m[3] or m[4] or ""
        if close:
            if is_open[name] > 0:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                was = drop_at
                pop(k)
                if was < 0:
                    tokens.append((name, 1, -1))
            if name in BLOCK:
                fresh, block_tag = True, next((x for x, _ in reversed(stack[-50:]) if x in BLOCK), "body")
            continue
        if is_open["head"] > 0 and name not in IN_HEAD:
            pop(next(k for k, (x, _) in enumerate(stack) if x == "head"))  # </head> may be left out
        if name in RAW and not attrs.endswith("/"):
            end = None if name in endless else re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if end:
                pos = end.end()
            elif name in UNSEEN:
                pos = n
            else:
                endless.add(name)
            if drop_at < 0:
                tokens.append(("cut", 1, -1))
            continue
        if name in BLOCK:
            if drop_at < 0:
                fresh, block_tag = True, name
            if is_open["p"] > 0 or (name in LISTED and is_open[name] > 0):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or (name in LISTED and stack[k][0] == name):
                        pop(k)
                        break
                    if stack[k][0] in CONTAINER and (name not in LISTED or stack[k][0] in LISTED[name]) or stack[k][0] in DROPPED:
                        break
        if drop_at < 0:
            tokens.append((name, 1, -1))
            if name == "br" and not fresh:
                blocks[-1].parts.append(" ")
        if name in VOID or attrs.endswith("/"):
            continue
        said = _names(attrs) if attrs and _NAMED.search(attrs) else []
        main = name in ("article", "main") or any("main" in words for words in said)
        bad = name in DROPPED or (name == "header" and is_open["article"] + is_open["main"] == 0)
        good = main
        if weights is None:
            tokens += [(f"name:{w}", 1, -1) for words in said for w in words]
        elif said and name not in ("body", "html", "main"):
            scores = [weights.name(words) for words in said]
            # An article goes only for being a comment.
            bad |= min(scores) < 0 and (name != "article" or any({"comment", "comments"} & set(words) for words in said))
            good |= max(scores) >= UNKNOWN and any(not GOOD.isdisjoint(words) for words in said)
            if drop_at < 0 and not main:
                tokens.append(("names", min(scores) if bad else max(scores), -1))
        if bad and drop_at < 0:
            drop_at = len(stack)
            tokens.append(("cut", 1, -1))
        k = -1
        if name in CONTAINER:
            k = len(tree.names)
            tree.names.append("good" if good else name)
            tree.around.append(inside[-1] if inside else -1)
            tree.last.append(-1)
            inside.append(k)
        stack.append((name, k))
        is_open[name] += 1
    pop(0)
    return tokens, blocks, tree


def learn(labelled: Iterable[str], names: Iterable[str] = LABELLED_NAMES) -> Weights:
    """Weights: how much likelier a word is inside the marks than outside, of a tag the same, but never above a small negative, and of the words of names."""

    def counted(pages: Iterable[str]) -> tuple[Counter, Counter]:
        inside, outside = Counter(), Counter()
        for html in pages:
            on = False
            for kind, amount, _ in read(html)[0]:
                if kind in _MAIN:
                    on = kind == _MAIN[0]
                else:
                    (inside if on else outside)[kind] += amount
        return inside, outside

    inside, outside = counted(labelled)
    odds = lambda k: math.log((inside[k] + 0.5) / (outside[k] + 0.5))
    tokens = {k: min(-0.05, odds(k)) for k in {*inside, *outside}} | {"word": max(0.5, odds("word")), "article": WALL, "main": WALL, "names": 1.0}
    inside, outside = counted(names)
    return Weights(tokens, {k.removeprefix("name:"): odds(k) for k in {*inside, *outside} if k.startswith("name:")})


def best(scores: list[float]) -> tuple[int, int]:
    """[lo, hi) of the contiguous run with the greatest sum; the first of equal ones."""
    top, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > top:
            top, lo, hi = run, start, i + 1
    return lo, hi


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    tokens, blocks, tree = read(html, weights)
    if not blocks:  # what tags and names set aside was the whole page: then only tags count
        tokens, blocks, tree = read(html)
    lo, hi = best([0.0 if kind.startswith("name:") else weights.tokens.get(kind, -1.0) * amount for kind, amount, _ in tokens])
    held = [b for _, _, b in tokens[lo:hi] if b >= 0]
    if not held:
        return ""
    a, b = min(held), max(held)
    first, last = min(x.inside for x in blocks[a : b + 1]), max(x.inside for x in blocks[a : b + 1])
    own = first
    while own >= 0 and not (tree.names[own] == "good" and tree.holds(own, last)):
        own = tree.around[own]

    def belongs(x: Block, edge: Block) -> bool:
        if own >= 0:
            return tree.holds(own, x.inside)
        return x.inside == edge.inside and x.tag not in ("body", "div", "td", "a") and x.linked < x.words

    while a > 0 and belongs(blocks[a - 1], blocks[a]):
        a -= 1
    while b + 1 < len(blocks) and belongs(blocks[b + 1], blocks[b]):
        b += 1
    return "\n".join(" ".join("".join(x.parts).split()) for x in blocks[a : b + 1])


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    known = weights or learn(LABELLED)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(x.as_py(), known) for x in part.column("html")]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    kind = dict(pages.dtypes)["page_id"]
    return cols(pages, "page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars bigint")
