"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page is read once into text blocks (what stands between block-level tags),
each with its open elements. A linear classifier gives every block a cost by
what marks it (element, class words), its length, its links and its form;
positive costs become capacities from the source (content), negative ones
capacities to the sink (boilerplate). Neighbouring blocks are joined by
smoothness edges, stronger the nearer they are in the tree, and so are a
parent's successive blocks with others between them. The minimum cut is the
cheapest labelling; blocks on the source's side are the main text.

A mark is *plain* where a class names the thing itself (``ad``, ``site-footer``,
``comment-list``) and *faint* where it only qualifies another (``warning-signs``,
``related-work``). A plain mark outweighs a block's own form; faint marks and
form are of the edges' order, so the cut decides by the neighbours.

Defined results: null html counts as empty and gives the empty string; broken
mark-up is read as browsers do (unknown ends ignored, ``p``, ``li`` and cells
closed by the next, what follows an unclosed comment, tag or script dropped,
elements nested deeper than ``DEEPEST`` not opened); a quote that nothing closes
is a character; ``br`` is white space; the control characters U+001C to U+001F
are no white space; equal rows and other columns stay. Reading takes time in
proportion to the page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, quoted, session, ship_code

#: Element classes of HTML (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template textarea title select datalist button svg math iframe object audio video canvas noembed noframes xmp map".split())
#: What a start tag closes if it is open, and where the search stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Words in class, id and role that mark boilerplate or content (fixed values).
OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside side rail footer foot header masthead topbar toolbar banner cookie cookies consent gdpr notice notices alert warning ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions related recommended recommendations recommend share sharing social follow comment comments respond reply replies discussion disqus newsletter subscribe subscription signup popup modal overlay dialog login search widget widgets pagination pager paging copyright legal disclaimer tagcloud skip print contentinfo complementary".split()
)
IN_WORDS = frozenset("article articlebody content contents post story entry main body text prose page".split())
#: Words that say nothing as the last of a compound: what comes before them is named (fixed values).
HOLDERS = frozenset("area articles bar block body box card column container content entry group inner item items layer left line links list main module news outer page panel posts region right row section slot stories strip text thread top topics unit wrap wrapper zone".split())
OUT_TAGS = frozenset("nav aside footer form menu dialog fieldset search".split())
IN_TAGS = frozenset(("article", "main"))
#: Blocks that are parts of what holds them (fixed values).
INNER = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address hr".split())
#: Browsers nest no deeper (a fixed value).
DEEPEST = 512

#: The classifier's weights: plain and faint marks, a block without marks on a page that marks its content, and the share of the page's text.
PLAIN_OUT, PLAIN_IN, FAINT, UNMARKED, HOLDER = -4.0, 3.0, 1.5, -2.5, 2.0
#: Smoothness: of neighbours in one element (divided by the square of the steps from one to the other), and of a parent's blocks with others between them.
NEXT, SIBLING = 4.0, 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def mark(token: str) -> tuple[int, float]:
    """What a class name says: a plain mark (-1, 0, 1) and the sum of faint ones."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in ("with", "has", "no"):
        return 0, 0.0
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    *before, last = words
    faint = -sum(w in OUT_WORDS for w in before)
    if last in OUT_WORDS:
        return -1, 0.0
    return (1, faint) if last in IN_WORDS else (0, faint)


class Node:
    """An open element: its tag, parent, depth, innermost block element, and the plain mark and faint marks that hold for its text."""

    __slots__ = ("tag", "parent", "depth", "block", "plain", "faint", "inside", "unseen", "link")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCKS or not parent else parent.block
        self.unseen = tag in UNSEEN or bool(parent and parent.unseen)
        self.link = tag == "a" or bool(parent and parent.link)
        self.inside = tag in IN_TAGS or bool(parent and parent.inside)
        plain, faint = -1 if tag in OUT_TAGS or tag == "header" and not self.inside else 1 if tag in IN_TAGS else 0, 0.0  # an article's own header holds its title
        if attrs and tag not in ("html", "body"):
            marks, styled = [], ""
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), html.unescape(a or b or c)
                if name in ("class", "id", "role"):
                    marks += map(mark, value.split())
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.unseen = True
                elif name == "style":
                    styled = value.replace(" ", "").lower()
            if "display:none" in styled or "visibility:hidden" in styled:
                self.unseen = True
            faint = max(-2.0, sum(f for _, f in marks))
            if tag not in IN_TAGS and any(p < 0 for p, _ in marks):
                plain = -1
            elif not plain and any(p > 0 for p, _ in marks):
                plain = 1
        self.plain = plain or (parent.plain if parent else 0)
        self.faint = faint if plain or not parent else max(-2.0, faint + parent.faint)


def tags(page: str):
    """(start, end, closing, name, attributes) of the page's tags, comments and the like with an empty name; reads every character once."""
    at, size, lone = 0, len(page), {}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            ends = [(e, e + len(x)) for x in ("-->", "--!>") if (e := page.find(x, start + 4)) >= 0] if "c" not in lone else []
            end = min(ends)[1] if ends else size
            if len(ends) < 2:
                at = end
            yield start, end, False, "", ""
            at = end
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None and not page.startswith(("!", "?", "/"), start + 1):
            at = start + 1  # a character
            continue
        if name is None:
            end = page.find(">", start + 1)
            end = size if end < 0 else end + 1
            yield start, end, False, "", ""
            at = end
            continue
        i = name.end()
        while True:
            i = _ATTRS.match(page, i).end()
            if i >= size or page[i] == ">":
                break
            quote = page[i]
            shut = page.find(quote, i + 1) if lone.get(quote, size) > i else -1
            if shut < 0:
                lone[quote] = min(lone.get(quote, size), i)  # none follows: found once
            i = shut + 1 if shut >= 0 else i + 1
        end = min(size, i + 1)
        yield start, end, closing, name[0].lower() if i < size else "", page[name.end() : i]
        at = end


def blocks(page: str) -> list[tuple[str, Node, float]]:
    """The page's text blocks in order: (text, innermost block element, share of its characters in links)."""
    out: list[tuple[str, Node, float]] = []
    top = Node("#root", None, "")
    node = home = top
    parts: list[str] = []
    linked = skip = done = 0
    opened, deep = Counter(), Counter()

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.append((text, home, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        if raw and not node.unseen:
            text = html.unescape(raw)
            parts.append(text)
            if node.link:
                linked += len(text.strip())

    def back_to(n):  # closes what is open below ``n``
        nonlocal node
        while node is not n:
            opened[node.tag] -= 1
            node = node.parent

    def up(names, stops=()):
        n = node
        while n.parent and n.tag not in names and n.tag not in stops:
            n = n.parent
        return n if n.parent and n.tag in names else None

    for start, end, closing, tag, attrs in tags(page):
        if start < skip:
            continue
        add(page[done:start])
        done = end
        if not tag:
            continue
        if closing:
            if deep[tag]:
                deep[tag] -= 1
            elif opened[tag]:
                if tag in BLOCKS:
                    flush()
                back_to(up((tag,)).parent)
                home = node.block
            elif tag == "p":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if node.block.tag == "p":
                back_to(node.block.parent)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]) and (n := up(*CLOSES[tag])):
            back_to(n.parent)
        if tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, end)
                skip = shut.start() if shut else len(page)
                if tag not in UNSEEN:
                    flush()
                done = skip
            elif node.depth >= DEEPEST:
                deep[tag] += 1
            else:
                node = Node(tag, node, attrs)
                opened[tag] += 1
        home = node.block
    add(page[done:])
    flush()
    return out


def _holder(n: Node) -> Node:
    """The element whose share of the page's text counts for a block: a paragraph's or an item's parent, any other block's own."""
    return n.parent.block if n.tag in INNER and n.parent else n


def scores(found: list[tuple[str, Node, float]]) -> list[float]:
    """The classifier: positive for content."""
    marked = any(n.plain > 0 for _, n, _ in found)
    held, total = Counter(), 0
    for text, n, _ in found:
        held[_holder(n)] += len(text)
        total += len(text)
    out = []
    for text, n, links in found:
        words = text.count(" ") + 1
        s = PLAIN_IN if n.plain > 0 else PLAIN_OUT if n.plain < 0 else UNMARKED if marked else 0.0
        s += FAINT * n.faint
        s += HOLDER * (min(1.0, held[_holder(n)] / total / 0.4) - 0.6)
        s += min(2.0, math.log2(1 + words) / 3) - 0.8
        s -= 4.0 * max(0.0, links - 0.4) * (1 if n.plain <= 0 else 0.5)
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption"):
            s += 0.4
        elif n.tag in ("p", "blockquote", "pre"):
            s += 0.6
        if text[-1:] in ".!?:;»\"'”’)" and words > 3:
            s += 0.4
        if text[:1] in "©" or "all rights reserved" in text.lower():
            s -= 2.0
        out.append(s)
    return out


def _distance(a: Node, b: Node) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[tuple[str, Node, float]]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, (_, n, _) in enumerate(found):
        if i:
            out.append((i - 1, i, NEXT / (1 + _distance(found[i - 1][1], n)) ** 2))
        parent = id(n.parent or n)
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def min_cut(terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; ties go to the sink's side.

    A node whose terminal capacity is at least all its edges together has its
    label in some minimum cut, so it is settled at once and its edges become
    capacities of its neighbours. Flow is pushed through the rest only.
    """
    n, s = len(terminal), list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        if abs(s[i]) > sum(near[i].values()) + 1e-12 or not near[i]:
            label[i] = s[i] > 0
            for j, c in near[i].items():
                s[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, s, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic's blocking flows)."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        cap[i] = dict(near[i])
    for i in nodes:
        if s[i] > 0:
            cap[source][i], cap[i][source] = s[i], 0.0
        elif s[i] < 0:
            cap[i][sink], cap[sink][i] = -s[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        arcs, at = {i: list(cap[i]) for i in level}, dict.fromkeys(level, 0)
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] += push
                path = [source]
            elif at[i] == len(arcs[i]):  # a dead end: its last arc is done
                path.pop()
                if path:
                    at[path[-1]] += 1
            elif cap[i][j := arcs[i][at[i]]] > 1e-12 and level.get(j) == level[i] + 1:
                path.append(j)
            else:
                at[i] += 1


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut(scores(found), edges(found))
    return "\n".join(text for (text, _, _), k in zip(found, keep) if k)


def extract(df: DataFrame, *, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the html) and the main text; no shuffle."""
    ship_code(session(df))
    keep = [c for c in (keep or df.columns) if c not in (html_col, out_col)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pages = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
            texts = [main_text(p).encode("utf-8", "replace").decode() for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, out_col])

    return map_arrow(df.select(*map(quoted, [*keep, html_col])), run, schema)
