"""HTML extraction by composite text density.

Every element of a page's tree has a density: its characters per tag, times a
logarithm that falls as more of its characters and tags belong to links, so
navigation scores low. An element's density sum adds the densities of its child
elements (its own, where it has none). The element of the body with the largest
sum is the content. The smallest density on the path from it up to the body is
the threshold: an element of equal or larger density, all of whose ancestors reach
it too, marks the largest sum of its own subtree as content, so text beside the
main block that is as dense as the path is kept, and the rest is dropped.

Tags and characters are counted below the element; an element without tags counts
as one. Scripts, styles, comments and templates have no characters. Void elements
have no children; p, li, dt, dd, tr, td, th and option are closed by their own
kind or by the end of their parent; unknown closing tags are ignored, and what
stays open closes at the end.

Attribute values in quotes may hold ``>``; a quote that is never closed doesn't
hide what follows.

Defined results: a null or empty page, and one without text, gives an empty text
and density 0; very long and very deep pages are parsed whole; where text is too short for any density above 0 the whole body is taken; of elements with equal sums the first in document order is taken; a
page without body is its own body; pages without id and repeated rows are extracted each; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._words import lean, slices
from lexweave.session import ship

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+(?:>|$)|[^<]+|<""", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a new element closes, up to the nearest of the listed scopes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html article section div".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul br".split())
#: Least value of the logarithm's base's logarithm, which is 0 on a page without links.
LEAST = 0.1
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in document order."""
    root = here = Node("#root", None)
    nodes = [root]
    depth: dict[str, int] = {}
    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            text = m.group(0)
            if text[0] != "<" or text == "<":
                here.parts.append(entities.unescape(text))
            continue
        tag = tag.lower()
        if m.group(2):
            if depth.get(tag):
                while here.tag != tag:
                    depth[here.tag] -= 1
                    here = here.parent
                depth[tag] -= 1
                here = here.parent
            continue
        closes = CLOSES.get(tag, ())
        if depth.get("p") and tag in BLOCKS and tag != "br":
            closes += ("p",)
        if closes:
            up = here
            while up.parent and up.tag not in SCOPES and up.tag not in closes:
                up = up.parent
            while up.tag in closes:
                while here is not up.parent:
                    depth[here.tag] -= 1
                    here = here.parent
                up = here
        node = Node(tag, here)
        here.parts.append(node)
        nodes.append(node)
        if tag not in VOID and not m.group(0).endswith("/>"):
            here = node
            depth[tag] = depth.get(tag, 0) + 1
    return root, nodes


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """Characters per tag, adjusted for links; factors that are 0 count as 1 in a denominator."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    other = max(chars - link_chars, 1)
    inner = chars / other * link_chars + body_link_chars / max(body_chars, 1) * chars + e
    value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * log(max(value, 1.0)) / max(log(log(inner)), LEAST)


def measure(nodes: list[Node]) -> Node:
    """Fill in counts, densities and sums; returns the body."""
    for n in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", p).strip()) for p in n.parts if isinstance(p, str))
        n.chars += own
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
        if n.parent:
            n.parent.chars += n.chars
            n.parent.tags += n.tags + 1
            n.parent.link_chars += n.link_chars
            n.parent.link_tags += n.link_tags + (n.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for n in reversed(nodes):
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, body.chars, body.link_chars)
        below = n.children()
        n.total = sum(c.density for c in below) if below else n.density
        n.best = n
        for c in below:
            if c.best.total > n.best.total:
                n.best = c.best
    return body


def text_of(marked: set[int], body: Node) -> str:
    """Text of the marked subtrees in document order, a line for each block."""
    out: list[str] = []
    stack: list[tuple[Node | str | None, bool]] = [(body, False)]
    while stack:
        part, inside = stack.pop()
        if part is None:
            out.append("\n")
        elif isinstance(part, str):
            if inside:
                out.append(part)
        else:
            inside = inside or id(part) in marked
            if part.tag in BLOCKS:
                out.append("\n")
                stack.append((None, inside))
            stack.extend((p, inside) for p in reversed(part.parts))
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(x if x == "\n" else _SPACE.sub(" ", x) for x in out).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(page: str | None) -> tuple[str, str, float, float]:
    """Content text, path of the chosen element, its density sum, and the threshold."""
    root, nodes = parse(page or "")
    body = measure(nodes)
    best = body.best
    if not best.total:
        return (text_of({id(body)}, body), "body", 0.0, 0.0) if body.chars else ("", "", 0.0, 0.0)
    path, limit, up = [], best.density, best
    while up is not None:
        if up.parent is not None:
            path.append(up.tag)
        limit = min(limit, up.density)
        if up is body:
            break
        up = up.parent
    marked: set[int] = set()
    stack = [body]
    while stack:
        n = stack.pop()
        if n.density >= limit and n.chars:
            marked.add(id(n.best))
            stack.extend(n.children())
    return text_of(marked, body), "/".join(reversed(path)), round(best.total, 6), round(limit, 6)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in slices(b.column(1)):
            text, path, total, limit = zip(*(extract(p) for p in b.column(1)[i:j].to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(text), pa.array(path), pa.array(total), pa.array(limit)], ["page_id", "content", "path", "density_sum", "threshold"])


def contents(pages: DataFrame) -> DataFrame:
    """Rows (page_id, content, path, density_sum, threshold), one for each page."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(lean(_extract), "page_id bigint, content string, path string, density_sum double, threshold double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over the whole pages table."""
    return contents(spark.read.parquet(f"{sf_dir}/pages.parquet"))
