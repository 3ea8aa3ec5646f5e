"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements; inline elements only add text to their block. Each block is
content or not. A node's evidence (words of its class, id and role; length and link share of its own text;
kind of tag) gives its potential, and each parent-child pair has a potential that depends on the kinds of
both. Sum-product messages pass up from the leaves and down from the root, and blocks whose marginal is at least
one half make up the text. All potentials are relative frequencies in labelled pages (``labelled``): layouts
written and labelled by hand (``html_layouts``), filled with sentences of many lengths.

Every page is parsed whole, by itself, in a task; memory is bounded by a batch of pages.

Edge cases: null html is an empty page and gives an empty text; broken, unclosed or cut-off markup is
read as browsers read it in spirit: unknown end tags are ignored, open elements end with the page; references
without a semicolon are decoded where HTML allows it. Extra columns stay. Repeated rows get equal texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dumpdeck.llm.html_layouts import labelled_pages

#: How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math canvas object audio video select textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
LISTS = frozenset("ul ol menu dl table".split())
KINDS = {
    "page": "html body", "main": "article main", "head": "head title", "aside": "nav aside footer form dialog menu address fieldset",
    "header": "header hgroup", "text": "p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption summary", "cell": "td th",
    "list": "ul ol dl table tbody thead tfoot tr", "box": "div section center details figure",
}
KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SMOOTH = 0.5


class Node:
    __slots__ = ("tag", "parent", "names", "children", "runs", "chars", "linked", "attributes")

    def __init__(self, tag: str, parent: int, names: frozenset, attributes: str = ""):
        self.tag, self.parent, self.names, self.attributes = tag, parent, names, attributes
        self.children: list[int] = []
        self.runs: list[tuple[int, str]] = []
        self.chars = self.linked = 0


def _names(attributes: str) -> frozenset:
    """Lower-case words of class, id and role."""
    if not attributes:
        return frozenset()
    values = " ".join(
        m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role", "itemprop")
    )
    return frozenset(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", values))


def parse(html: str) -> list[Node]:
    """Block elements in page order, the page itself first, with runs of text numbered in page order.

    Text outside all elements belongs to a body of its own, as browsers have it. Time is linear in the page: the depths of open
    elements are kept by tag.
    """
    nodes, open_ = [Node("html", -1, frozenset())], [0]
    depths: dict[str, list[int]] = defaultdict(list)
    links, piece, run = 0, [], 0
    at, size = 0, len(html)

    def close() -> None:
        nonlocal run
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                node = nodes[open_[-1]]
                if len(open_) == 1:
                    node.children.append(len(nodes))
                    body = Node("body", 0, frozenset())
                    body.linked, node.linked = node.linked, 0
                    nodes.append(body)
                    node = body
                node.runs.append((run, text))
                node.chars += len(text)
                run += 1
            piece.clear()

    def cut(depth: int) -> None:
        """Close the element at a depth and all inside it."""
        close()
        while len(open_) > depth:
            depths[nodes[open_.pop()].tag].pop()

    def deepest(tags: tuple[str, ...] | frozenset) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def end(tags: tuple[str, ...], barrier: frozenset = LISTS) -> None:
        depth = deepest(tags)
        if depth > deepest(barrier):
            cut(depth)

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text = html[at:lt]
            if "&" in text:
                text = unescape(text)
            piece.append(text)
            if links:
                nodes[open_[-1]].linked += len(text.strip())
        if lt == size:
            break
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = size if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = size if stop < 0 else stop + 1
            continue
        m = TAG.match(html, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):  # a tag that the page's end, or a stray quote, cuts off
                stop = html.find(">", lt)
                at = size if stop < 0 else stop + 1
            else:
                piece.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "a":
                links = 0
            elif tag == "br" or tag in INLINE or tag in VOID:
                pass
            elif tag != "html" and depths.get(tag):
                cut(depths[tag][-1])
                links = 0
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = stop.end() if stop else size
            piece.append(" ")
        elif tag == "a":
            links = 1
        elif tag in INLINE or tag == "wbr":
            pass
        elif tag == "hr":
            end(("p",))
            close()
        elif tag in VOID:
            piece.append(" ")
        elif tag != "html" and not (tag == "body" and depths.get("body")):
            if tag in ENDS_P:
                end(("p",), frozenset())
            if tag == "body":
                end(("head",))
            if tag in CLOSES:
                end(CLOSES[tag])
            if tag[0] == "h" and tag[1:] in "123456":
                if nodes[open_[-1]].tag[0] == "h" and nodes[open_[-1]].tag[1:] in tuple("123456"):
                    end((nodes[open_[-1]].tag,))
            close()
            links = 0
            nodes.append(Node(tag, open_[-1], _names(m[3]), m[3]))
            nodes[open_[-1]].children.append(len(nodes) - 1)
            depths[tag].append(len(open_))
            open_.append(len(nodes) - 1)
    close()
    return nodes


def kind(node: Node) -> str:
    """Kind of tag; boxes without class, id and role are a kind of their own."""
    found = KIND.get(node.tag, "box")
    return "plain" if found == "box" and not node.names else found


def evidence(node: Node) -> list[tuple[str, str]]:
    """(feature, value) pairs of one node; words of names count one by one."""
    share = node.linked / node.chars if node.chars else 0.0
    size = min(5, int(math.log2(1 + node.chars / 16)))
    found = [("tag", node.tag), ("links", "none" if not node.linked else "some" if share < 0.5 else "most")]
    if kind(node) not in ("text", "list"):
        found.append(("size", f"{kind(node)} {size}"))
    return found + [("name", w) for w in node.names]


class Model:
    """Log potentials counted from labelled pages."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]]):
        values: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        edges: dict[tuple, Counter] = defaultdict(Counter)
        totals: dict[str, Counter] = defaultdict(Counter)
        self.root = [0.0, -20.0]
        for nodes, labels in pages:
            for i, node in enumerate(nodes):
                for feature, value in evidence(node):
                    values[feature][value][labels[i]] += 1
                    totals[feature][labels[i]] += 1
                if node.parent >= 0:
                    edges[kind(nodes[node.parent]), kind(node), labels[node.parent]][labels[i]] += 1
        self.nodes = {
            (f, v): tuple(
                math.log((c[y] + SMOOTH) / (totals[f][y] + SMOOTH * (len(by) + 1))) for y in (0, 1)
            )
            for f, by in values.items()
            for v, c in by.items()
        }
        self.edges = {
            k: tuple(math.log((c[y] + SMOOTH) / (sum(c.values()) + 2 * SMOOTH)) for y in (0, 1)) for k, c in edges.items()
        }

    def edge(self, parent: Node, child: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        """Log P(child's label | parent's label), by the parent's; unseen pairs of kinds mostly agree."""
        a, b = kind(parent), kind(child)
        like = math.log(0.9), math.log(0.1)
        return self.edges.get((a, b, 0), like), self.edges.get((a, b, 1), like[::-1])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by messages up and down the tree."""

        def add(a: float, b: float) -> float:
            m = max(a, b)
            return m + math.log(math.exp(a - m) + math.exp(b - m))

        n = len(nodes)
        own = []
        for node in nodes:
            e = [0.0, 0.0]
            for pair in evidence(node):
                w = self.nodes.get(pair)
                if w:
                    e[0] += w[0]
                    e[1] += w[1]
            own.append(e)
        own[0] = [own[0][0] + self.root[0], own[0][1] + self.root[1]]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # a child comes after its parent
            node = nodes[i]
            (p00, p01), (p10, p11) = self.edge(nodes[node.parent], node)
            e0, e1 = own[i]
            up[i] = add(p00 + e0, p01 + e1), add(p10 + e0, p11 + e1)
            own[node.parent][0] += up[i][0]
            own[node.parent][1] += up[i][1]
        down = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i, node in enumerate(nodes):
            if i:
                (p00, p01), (p10, p11) = self.edge(nodes[node.parent], node)
                # What the parent believes without this child's own message.
                q0 = own[node.parent][0] + down[node.parent][0] - up[i][0]
                q1 = own[node.parent][1] + down[node.parent][1] - up[i][1]
                m = max(q0, q1)
                down[i] = add(q0 - m + p00, q1 - m + p10), add(q0 - m + p01, q1 - m + p11)
            b0, b1 = own[i][0] + down[i][0], own[i][1] + down[i][1]
            out[i] = 1 / (1 + math.exp(min(700.0, b0 - b1)))
        return out


def labelled(without: frozenset[str] = frozenset()) -> list[tuple[list[Node], list[int]]]:
    """Parsed layouts with labels: a node is content from a ``data-main`` down to a ``data-rest``."""
    pages = []
    for html in labelled_pages(without=without):
        nodes = parse(html)
        labels = []
        for node in nodes:
            up = labels[node.parent] if node.parent >= 0 else 0
            labels.append(1 if "data-main" in node.attributes else 0 if "data-rest" in node.attributes else up)
        pages.append((nodes, labels))
    return pages


def fit() -> Model:
    return Model(labelled())


def main_text(html: str | None, model: Model) -> str:
    nodes = parse(html or "")
    runs = [run for node, p in zip(nodes, model.marginals(nodes), strict=True) if p >= 0.5 for run in node.runs]
    return "\n".join(text for _, text in sorted(runs))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text, instead of ``html``. A column ``text`` is replaced."""
    others = [c for c in pages.columns if c not in (html, text)]
    schema = T.StructType([pages.schema[c] for c in others] + [T.StructField(text, T.StringType())])
    model = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, model) for h in part.column(part.schema.get_field_index(html)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*others, text])

    return pages.select(*others, html).mapInArrow(run, schema)
