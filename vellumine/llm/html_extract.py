"""Main text of web pages by tree scoring.

Each paragraph earns points for its length and its commas and passes them to its
ancestors, less with each level. A container's points are discounted by the
share of its text that stands in links. The best container gives the page's
text, together with those of its siblings that score well themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import lean, row_slices, table

#: Paragraphs shorter than this earn nothing.
MIN_CHARS = 25
#: Share of the best score from which a sibling is kept, and the least score for that.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
#: A sibling paragraph of this length with few links is kept whatever its score.
LONG_PARAGRAPH, FEW_LINKS = 80, 0.25
#: Levels above a paragraph that get points.
LEVELS = 5

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|[!?][^>]*>)""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg iframe".split())
_SKIP = frozenset("nav footer aside form button select option header menu dialog".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: An opening tag closes an open one of these, unless a tag of the second kind stands between.
_CLOSES = {
    **{t: (frozenset(["p"]), frozenset("div article section td th li body blockquote main aside".split())) for t in _BLOCK - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot"}},
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


class Node:
    __slots__ = ("tag", "parent", "items", "score", "chars", "linked", "skip")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.score = 0.0
        self.chars = self.linked = 0
        self.skip = tag in _SKIP or bool(parent and parent.skip)

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree, and its nodes in order of their opening; tags that aren't closed end with what holds them."""
    root = Node("#root", None)
    nodes, top, at = [root], root, 0
    opened: Counter[str] = Counter()  # tags on the way from the root to ``top``; what isn't there needn't be looked for

    def leave(node: Node) -> Node:
        """The parent of an open node, with all that is open inside it closed."""
        x = top
        while True:
            opened[x.tag] -= 1
            if x is node:
                return node.parent
            x = x.parent

    def text(a: int, b: int) -> None:
        if a < b and (t := html[a:b]) and not t.isspace():
            top.items.append(unescape(t) if "&" in t else t)

    find = _TAG.search
    while m := find(html, at):
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = leave(node)
            continue
        if (rule := _CLOSES.get(tag)) and any(opened[t] > 0 for t in rule[0]):
            node = top
            while node.parent and node.tag not in rule[0] and node.tag not in rule[1]:
                node = node.parent
            if node.tag in rule[0]:
                top = leave(node)
        if tag in _VOID:
            if tag in ("br", "hr"):
                top.items.append("\n")
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = _END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        node = Node(tag, top)
        top.items.append(node)
        nodes.append(node)
        opened[tag] += 1
        top = node
    text(at, len(html))
    return root, nodes


def _own_text(node: Node) -> str:
    """Text of a paragraph with its inline parts, but without blocks inside it."""
    out, stack = [], [iter(node.items)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _BLOCK:
                stack.append(iter(x.items))
                break
        else:
            stack.pop()
    return _SPACE.sub(" ", "".join(out)).strip()


def _measure(nodes: list[Node]) -> None:
    """Characters of each node, and those in links."""
    for node in reversed(nodes):
        node.chars += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def points(text: str) -> float:
    return 1.0 + text.count(",") + min(len(text) / 100.0, 3.0) if len(text) >= MIN_CHARS else 0.0


def extract(html: str) -> tuple[str, str | None, float]:
    """(text, tag of the container, its score); without any scoring paragraph the text is empty."""
    root, nodes = parse(html)
    _measure(nodes)
    texts: dict[int, str] = {}
    scored = []
    for node in nodes:
        if node.skip or not node.parent:
            continue
        loose = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(x, str) and not x.isspace() for x in node.items)
        if node.tag not in _PARAGRAPH and not loose:
            continue
        texts[id(node)] = t = _own_text(node)
        if p := points(t):
            up, level = (node if loose else node.parent), 1
            while up and level <= LEVELS:
                if not up.score:
                    scored.append(up)
                up.score += p / (1 if level == 1 else 2 if level == 2 else 3 * level)
                up, level = up.parent, level + 1
    if not scored:
        return "", None, 0.0
    final = {id(n): n.score * (1 - n.density) for n in scored}
    place = {id(n): i for i, n in enumerate(nodes)}
    best = max(scored, key=lambda n: (final[id(n)], -place[id(n)]))
    score = final[id(best)]
    keep = [best]
    if best.parent:
        keep = []
        for x in best.parent.items:
            if isinstance(x, str):
                continue
            if x is best or not x.skip and (
                final.get(id(x), 0.0) >= max(SIBLING_LEAST, SIBLING_SHARE * score)
                or x.tag == "p" and len(texts.get(id(x), "")) > LONG_PARAGRAPH and x.density < FEW_LINKS
            ):
                keep.append(x)
    return "\n".join(t for n in keep for t in _lines(n)), best.tag, score


def _lines(node: Node) -> list[str]:
    """The text of a container, a line for each block; what is skipped and what is mostly links stays out."""
    lines, part = [], []

    def flush() -> None:
        if part and (t := _SPACE.sub(" ", "".join(part)).strip()):
            lines.append(t)
        part.clear()

    stack: list[tuple[Node, Iterator]] = [(node, iter(node.items))]
    while stack:
        own, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                part.append(x)
                continue
            if x.skip or x.tag in ("ul", "ol", "div", "table") and x.density > 0.5:
                continue
            if x.tag in _BLOCK:
                flush()
            stack.append((x, iter(x.items)))
            break
        else:
            stack.pop()
            if own.tag in _BLOCK or not stack:
                flush()
    return lines


_ARROW = pa.schema([("page_id", pa.int64()), ("container", pa.string()), ("score", pa.float64()), ("n_chars", pa.int64()), ("text", pa.string())])


def main_text(pages: DataFrame) -> DataFrame:
    """For each page: page_id, container (tag), score, n_chars, text.

    A null, empty or textless page, or one whose paragraphs are all short, has an
    empty text, a null container and score 0. Of containers with the same score
    the one that opens first is taken. A null page_id stays null, repeated rows
    stay repeated. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "html"):
            ids, rows = batch.column("page_id").to_pylist(), []
            for h in batch.column("html").to_pylist():
                t, tag, score = extract(h or "")
                rows.append((tag, round(score, 4), len(t), t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, *zip(*rows)), _ARROW.types)], schema=_ARROW)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(lean(run), "page_id long, container string, score double, n_chars long, text string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
