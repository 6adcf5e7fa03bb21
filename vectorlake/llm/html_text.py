r"""Main-text extraction by composite text density.

A page becomes a small DOM.  For every node, C characters, T tags, LC link characters and LT link tags below it give
the composite density

    C / T * ln(C/LC * T/LT) / ln(ln(C/(C-LC) * LC + LC_body/C_body * C + e) + e - 1)

(counts in denominators are 1 at least; ``e - 1`` keeps the base above 1 on pages without links).  Scripts, styles and form
controls hold no text of the page and are left out.  A node's density sum adds its children's densities; the node with the largest
sum is the core, and the lowest density on its path to the body is the threshold.  Nodes outside the core that reach it are
main text, too, as articles may be split over containers.

What a node is called is a prior only: the density sum of an ``article`` or ``main`` element counts ``MAIN`` times, and the density of a node that is named like boilerplate (an element such as ``nav`` or
``footer``, a role, class or id) or whose text is mostly links counts ``PRIOR`` times.  Its density decides: inside the main text such a
node goes if its discounted density is below the threshold, or below ``DENSE`` times the density of the core, and stays if it is as
dense as the article itself.

Edge cases: null or empty html and pages without text give the empty string; malformed and unclosed markup is closed as
browsers do in the common cases; deep nesting needs no recursion; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math object canvas audio video select xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "title", "legend"}
#: An opening tag ends an open element of these kinds, but not beyond the given boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Controls, whose text is none of the page's.
CONTROLS = frozenset("form button input dialog".split()) | RAW
# fixed values: what names the main text and what boilerplate
CONTENT = frozenset({"article", "main"})
NAMED_TAGS = frozenset("nav aside footer fieldset menu".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notification alert popup newsletter "
    "subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments replies share sharing social related "
    "recommended widget pagination".split()
)
#: Density factor of what is named so or holds mostly links, and the least density of such a node, relative to the core.
PRIOR, DENSE = 0.2, 0.5
#: Factor of the density sum of an element that is named as the main text.
MAIN = 10

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "cut", "doubted", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.cut = self.doubted = False
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def parse(page: str) -> tuple[Node, list[Node]]:
    """The body and all nodes in page order."""
    root = Node("html", "", None)
    nodes, top, at, n = [root], root, 0, len(page)
    still_open: Counter[str] = Counter()  # so that no step climbs in vain: each node is left once

    def leave(upto: Node) -> Node:
        node = top
        while node is not upto:
            still_open[node.tag] -= 1
            node = node.parent
        return upto

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            top.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # closes the nearest open element of that name
            if still_open[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = leave(node.parent)
            elif tag == "p":
                top.items.append(Node("p", "", top))
            continue
        if tag in ("html", "body", "head"):
            if m[3]:
                root.attrs += m[3]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in ("svg", "math", "object") or end:
                at = end.end() if end else n
            continue
        if tag in CLOSES_P and still_open["p"]:
            node = top
            while node is not root and node.tag != "p" and node.tag not in ("td", "th", "button", "div", "article", "section"):
                node = node.parent
            if node.tag == "p":
                top = leave(node.parent)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            node, last, left = top, None, sum(still_open[x] for x in ends)
            while left and node is not root and node.tag not in bounds:
                if node.tag in ends:
                    last, left = node, left - 1
                node = node.parent
            if last is not None:
                top = leave(last.parent)
        node = Node(tag, m[3], top)
        nodes.append(node)
        top.items.append(node)
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCK - VOID:
            top = node
            still_open[tag] += 1
    if at < n:
        top.items.append(page[at:])
    return root, nodes


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _names(nodes: list[Node]) -> None:
    """Cut controls and hidden nodes; mark as doubted what is named like boilerplate."""
    inside: dict[int, bool] = {}
    holds: set[int] = set()  # forms around a heading, as some pages are one form
    for node in nodes:
        inside[id(node)] = node.tag in CONTENT or node.parent is not None and inside[id(node.parent)]
        if node.tag in CONTENT or node.tag == "h1":
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for node in nodes[1:]:
        attrs = _attributes(node.attrs) if node.attrs else {}
        called = set(_NAME.findall(_CAMEL.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))
        node.cut = node.parent.cut or node.tag in CONTROLS and not (node.tag == "form" and id(node) in holds) or "hidden" in attrs or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
        named = node.tag in NAMED_TAGS or node.tag == "header" and not inside[id(node)] or bool(called & NAMES) or attrs.get("role", "").lower() in NAMED_ROLES
        node.doubted = named and node.tag not in CONTENT and node.tag != "h1"


def _measure(nodes: list[Node]) -> None:
    live = [x for x in nodes if not x.cut]
    for node in reversed(live):  # children come after their parents
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(html.unescape(x).split()))
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.links += x.links + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = live[0]
    share = body.link_chars / max(body.chars, 1)
    for node in live:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.links, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e) + math.e - 1
            node.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1)) / math.log(base)
        node.doubted = node.doubted or node.links > 1 and 2 * lc > c and node.tag in BLOCK and node is not body
    for node in live:
        if node.parent is not None and node.parent.doubted:
            node.doubted = True  # a part of a doubted block
        if node.doubted:
            node.density *= PRIOR
    for node in live:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.cut)
        if node.tag in CONTENT:
            node.total *= MAIN


def _cores(body: Node, nodes: list[Node]) -> list[Node]:
    """Disjoint subtrees that make up the main text, in page order, without their doubted parts of low density."""
    live = [x for x in nodes if not x.cut and x.chars]
    if not live:
        return []
    core = max(live, key=lambda x: (x.total, x.density))
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    dense = max(threshold, DENSE * core.density)
    for node in live:
        node.cut = node.cut or node.doubted and node.density < dense and node is not body
    chosen = {id(core)}
    for node in live:  # other containers as dense as the path
        if node is not body and not node.doubted and not node.cut and node.density >= threshold and node.tag in BLOCK:
            chosen.add(id(node))
    out: list[Node] = []
    taken: set[int] = set()
    for node in live:
        if node.parent is not None and id(node.parent) in taken:
            taken.add(id(node))
        elif id(node) in chosen:
            taken.add(id(node))
            out.append(node)
    # Cores in one container: take the container, short blocks between them included.
    return [_common(out)] if out else []


def _common(nodes: list[Node]) -> Node:
    def up(node):
        path = []
        while node is not None:
            path.append(node)
            node = node.parent
        return path[::-1]

    paths = [up(x) for x in nodes]
    shared = paths[0][0]
    for level in zip(*paths):
        if any(x is not level[0] for x in level):
            break
        shared = level[0]
    return shared


def _blocks(root: Node) -> list[str]:
    blocks: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.cut:
            if x.tag == "br":
                parts.append(" ")
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
                stack += x.items[::-1]
            else:
                stack += x.items[::-1]
    flush()
    return blocks


def extract(page: str | None) -> str:
    if not page:
        return ""
    body, nodes = parse(page)
    _names(nodes)
    _measure(nodes)
    return "\n\n".join(b for core in _cores(body, nodes) for b in _blocks(core))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
