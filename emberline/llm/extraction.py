"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is boilerplate, content or a mix.  Its tag, its names, its share of link
text and its length give evidence; potentials between parent and child say how labels follow each other down the
tree.  Both are learned from labelled pages.  Sum-product message passing, up from the leaves and down from the root,
gives each node's marginals; text whose block is likelier content than boilerplate is kept.  Siblings are much alike,
so the messages of many children are tempered to weigh as those of a few; a long list does not outvote its parent.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.html_pages import HIDDEN, labelled_pages

BOILERPLATE, CONTENT, MIX = range(3)
# Element classes of the HTML standard; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"])
NEVER = frozenset([*HIDDEN, "head", "textarea", "title", "select", "option", "button", "input", "object", "canvas", "math", "map", "datalist", "dialog", "noembed", "noframes", "audio", "video"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split())
BREAK = frozenset(["br", "hr", "img", "input", "embed"])
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Elements that end the search for something to close.
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form fieldset blockquote td th button".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|data-y|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Za-z][a-z]*")


#: Weight of each kind of evidence: sizes vary within any label, names are given on purpose.
TRUST = {"tag": 1.0, "link": 1.0, "size": 0.3, "own": 0.3, "name": 2.0}
#: Children whose messages count in full.
FULL_CHILDREN = 4


class Node:
    __slots__ = ("tag", "names", "parent", "y", "text", "linked", "own", "never")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, y: str | None, never: bool):
        self.tag, self.names, self.parent, self.y, self.never = tag, names, parent, y, never
        self.text = self.linked = self.own = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the page's text in order: (block, text run).

    A run ends where a block or a line ends.  Broken pages are read as browsers do in the common cases: a missing end
    tag is implied by what follows or by its parent's end; a stray end tag is passed over.
    """
    nodes = [Node("", (), -1, None, False)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, its block, inside a link
    held: list[str] = []

    def flush() -> None:
        if held:
            run = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if run:
                runs.append((stack[-1][1], run))

    def take(raw: str) -> None:
        if raw:
            held.append(raw)
            size = len(raw) - raw.count(" ")
            node = nodes[stack[-1][1]]
            node.own += size
            if stack[-1][2]:
                node.linked += size

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if any(t == tag for t, _, _ in stack[1:]):
                if tag not in INLINE:
                    flush()
                while stack[-1][0] != tag:
                    if tag in INLINE and stack[-1][0] not in INLINE:
                        break  # an inline end tag does not end blocks
                    stack.pop()
                else:
                    stack.pop()
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1], stack[-1][2] or tag == "a"))
            continue
        flush()
        if tag in BREAK or tag in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[k][0], ()):
                del stack[k:]
                break
            if stack[k][0] in SCOPE:
                break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        names: list[str] = []
        y, never = None, tag in NEVER
        if m.group(3):
            for a in ATTR.finditer(m.group(3)):
                key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if key == "data-y":
                    y = value
                elif key == "style":
                    never |= "display:none" in value.replace(" ", "").lower()
                elif key in ("hidden", "aria-hidden"):
                    never |= value.lower() not in ("false",)
                else:
                    names += [w.lower() for w in NAME.findall(value)]
        up = stack[-1][1]
        if not m.group(3).rstrip().endswith("/"):
            nodes.append(Node(tag, tuple(sorted(set(names))), up, y, never))
            stack.append((tag, len(nodes) - 1, stack[-1][2]))
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.text += node.own
        if i:
            nodes[node.parent].text += node.text
            nodes[node.parent].linked += node.linked
    return nodes, runs


def evidence(node: Node) -> tuple[str, ...]:
    """What is seen of a node, as discrete features."""
    share = node.linked / node.text if node.text else 0.0
    size = min(8, int(math.log2(node.text / 8 + 1))) if node.text else -1
    return (f"tag {node.tag}", f"link {int(share * 4)}", f"size {size}", f"own {min(3, int(math.log2(node.own / 16 + 1))) if node.own else -1}",
            *(f"name {w}" for w in node.names))


class TreeModel:
    """Log-potentials of nodes and edges, counted on labelled pages."""

    def __init__(self, pages: list[str]):
        seen: dict[str, Counter] = defaultdict(Counter)
        labels: Counter = Counter()
        edges = [[1.0] * 3 for _ in range(3)]
        for page in pages:
            nodes, _ = parse(page)
            ys: list[int] = []
            for node in nodes:
                inherited = ys[node.parent] if node.parent >= 0 else MIX
                y = {"c": CONTENT, "b": BOILERPLATE, "m": MIX}[node.y] if node.y else inherited
                ys.append(y)
                labels[y] += 1
                if node.parent >= 0:
                    edges[ys[node.parent]][y] += 1
                for f in evidence(node):
                    seen[f][y] += 1
        self.edge = [[math.log(v / sum(row)) for v in row] for row in edges]
        self.prior = [math.log((labels[y] + 1) / (sum(labels.values()) + 3)) for y in range(3)]
        # Evidence is a likelihood ratio against the label's own frequency; unseen evidence is neutral.
        self.weight = {
            f: tuple(TRUST[f.split()[0]] * (math.log((c[y] + 0.5) / (labels[y] + 1)) - math.log((sum(c.values()) + 1.5) / (sum(labels.values()) + 3))) for y in range(3))
            for f, c in seen.items()}
        self.known: dict[tuple[str, ...], tuple[float, float, float]] = {}

    def local(self, node: Node) -> tuple[float, float, float]:
        if node.never:
            return (0.0, -40.0, -40.0)
        seen = evidence(node)
        out = self.known.get(seen)
        if out is None:
            sums = [0.0, 0.0, 0.0]
            for f in seen:
                w = self.weight.get(f)
                if w:
                    for y in range(3):
                        sums[y] += w[y]
            if len(self.known) > 50_000:
                self.known.clear()
            out = self.known[seen] = (sums[0], sums[1], sums[2])
        return out

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Marginals of every node's label by two sweeps of messages."""
        edge = [[math.exp(v) for v in row] for row in self.edge]
        n = len(nodes)
        children = [0] * n
        for node in nodes[1:]:
            children[node.parent] += 1
        belief = [[math.exp(v) for v in self.local(node)] for node in nodes]
        up: list[list[float]] = [[1.0] * 3] * n
        for i in range(n - 1, 0, -1):
            b = belief[i]
            total = b[0] + b[1] + b[2] or 1e-300
            b[0] /= total
            b[1] /= total
            b[2] /= total
            m = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in edge]
            if children[nodes[i].parent] > FULL_CHILDREN:
                m = [v ** (FULL_CHILDREN / children[nodes[i].parent]) for v in m]
            up[i] = m
            p = belief[nodes[i].parent]
            scale = max(p) or 1.0
            for y in range(3):
                p[y] = max(p[y] * m[y] / scale, 1e-200)
        belief[0] = [b * math.exp(p) for b, p in zip(belief[0], self.prior, strict=True)]
        for i in range(n):
            b = belief[i]
            if i:
                p, m = belief[nodes[i].parent], up[i]
                rest = [p[y] / m[y] for y in range(3)]
                b = [b[y] * (rest[0] * edge[0][y] + rest[1] * edge[1][y] + rest[2] * edge[2][y]) for y in range(3)]
            total = sum(b) or 1.0
            belief[i] = [v / total for v in b]
        return belief

    def extract(self, page: str | None) -> str:
        nodes, runs = parse(page or "")
        if not runs:
            return ""
        belief = self.marginals(nodes)
        # Boilerplate ends at no inner node: what stands below a menu or comment stays out.
        out = [True] * len(nodes)
        for i, node in enumerate(nodes):
            b = belief[i]
            out[i] = (b[CONTENT] <= b[BOILERPLATE]) or node.never or (node.parent >= 0 and nodes[node.parent].never)
            node.never |= node.parent >= 0 and nodes[node.parent].never
        return " ".join(run for block, run in runs if not out[block])


def trained(pages: list[str] | None = None) -> TreeModel:
    return TreeModel(labelled_pages() if pages is None else pages)


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty page, or one without an article, has an empty text.  Repeated rows give repeated rows; other
    columns are not touched.  Pages stream through once, without a shuffle; the model is a few hundred numbers.
    """
    model = model or trained()
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
