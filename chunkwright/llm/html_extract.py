"""Main text of web pages by scoring the tree of elements.

Parsing. One regular expression cuts the page into tags, comments and text. Elements nest by an own stack: void elements have no content;
a block closes an open p, and li, tr, td, th, dd, dt, option close their like; an end tag closes what is open down to its start
tag, or is ignored if there is none. The content of script, style, noscript, template, iframe and svg, of comments,
and of head is dropped; nav, footer, aside, form, button and select count as links (their text is never content). Character references are resolved.

Scoring. An element's characters are those of its pieces of text (blanks run together, none at a piece's ends), without what is dropped. Every p, pre, td,
blockquote and li of at least 25 characters of its own (not in another such element) gives 1 point, 1 for each comma and 1 for each
100 characters, up to 3, to its parent in full, to the grandparent a half, to each further ancestor half of what the one below it got. A candidate's points
are multiplied by 1 - link density (the characters in links, dropped ones among them, by all characters). The best candidate is taken, of equal ones the first in the page; and of its siblings
those with at least max(10, a fifth of its score), and p siblings of link density < 0.25 and more than 80 characters of text, or without
links, shorter and with a sentence end. A page without a candidate gives the text of its body.

Text: the paragraphs of what is kept, blanks run together, one line each; br and block elements end a line.

Result: (page_id, text, score, n_paragraphs) of every row; null for a null page, '' (score 0) for an empty one or one without text.
Repeated rows give repeated results. Long and deeply nested pages are handled without recursion, in time proportional to their length: a tag without an end
stops at the next "<", and points, characters and commas are sums from the leaves up. No shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import common as C

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
BLOCK = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body html option select".split())
DROP = frozenset("head nav footer aside form button select".split())
GIVES = frozenset("p pre td blockquote li".split())
#: Of each implied end tag, what it closes and the elements beyond which it doesn't reach.
REACH = [({"p"}, {"table", "td", "th", "button"}), ({"li"}, {"ul", "ol", "table"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"table"}), ({"dd", "dt"}, {"dl"}), ({"option"}, {"select"})]
KIND = {"li": 1, "tr": 2, "td": 3, "th": 3, "dd": 4, "dt": 4, "option": 5}
SPECIAL = frozenset().union(*(x | y for x, y in REACH))
LEAST, PER, SHARE = 25, 100, 0.2
END = re.compile(r"[.!?](?:\s|$)")
BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "link", "dropped", "length", "linked", "kept", "commas", "score", "scored", "order", "near")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.parts, self.order = tag, parent, [], order
        self.link = tag == "a" or (parent is not None and parent.link)
        self.dropped = tag in DROP or (parent is not None and parent.dropped)
        self.length = self.linked = self.kept = self.commas = 0
        self.score, self.scored = 0.0, False
        #: Of each kind of implied end tag, the element it would close.
        self.near: tuple = (None,) * len(REACH) if parent is None else parent.near
        if tag in SPECIAL:
            self.near = tuple(self if tag in closed else None if tag in barrier else n for n, (closed, barrier) in zip(self.near, REACH))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in the page's order."""
    root = Node("#root", None, 0)
    nodes, node, at, low = [root], root, 0, None
    open_count: dict[str, int] = {}

    def close_to(target: Node) -> None:
        nonlocal node
        while node is not target:
            open_count[node.tag] -= 1
            node = node.parent
        open_count[node.tag] -= 1
        node = node.parent

    find = TOKEN.search
    while True:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root, nodes
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group() == "<":
                node.parts.append("<")
            continue
        tag = tag.lower()
        if m.group(1):
            if open_count.get(tag):
                n = node
                while n.tag != tag:
                    n = n.parent
                close_to(n)
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
                if len(low) != len(page):  # a character whose lower case is longer
                    low = "".join(c.lower() if c < "\x80" else c for c in page)
            if not m.group(3).endswith("/"):
                end = low.find("</" + tag, at)
                stop = -1 if end < 0 else page.find(">", end)
                at = len(page) if stop < 0 else stop + 1
            continue
        if tag in BLOCK and node.near[0] is not None:
            close_to(node.near[0])
        if tag in KIND:
            while (n := node.near[KIND[tag]]) is not None:
                close_to(n)
        child = Node(tag, node, len(nodes))
        nodes.append(child)
        node.parts.append(child)
        if tag not in VOID and not m.group(3).endswith("/"):
            node = child
            open_count[tag] = open_count.get(tag, 0) + 1


def squeeze(text: str) -> str:
    return BLANKS.sub(" ", text).strip()


def measure(nodes: list[Node]) -> None:
    """Characters of each element's subtree, those in links (what is dropped counts as links), and characters and commas of what isn't dropped."""
    for n in reversed(nodes):
        for p in n.parts:
            if type(p) is str:
                text = squeeze(p)
                n.length += len(text)
                if n.link or n.dropped:
                    n.linked += len(text)
                if not n.dropped:
                    n.kept += len(text)
                    n.commas += text.count(",")
        if (up := n.parent) is not None:
            up.length += n.length
            up.linked += n.linked
            up.kept += n.kept
            up.commas += n.commas


def density(n: Node) -> float:
    return n.linked / n.length if n.length else 0.0


def lines(top: Node) -> list[str]:
    """The subtree's text by lines, without what is dropped."""
    out, line = [], []

    def end() -> None:
        if line and (text := squeeze("".join(line))):
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if type(x) is str:
            line.append(x)
        elif x is None:
            end()
        elif x.tag == "br":
            end()
        elif not x.dropped or x is top:
            block = x.tag in BLOCK
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(x.parts))
    end()
    return out


def inner_text(n: Node) -> str:
    return " ".join(lines(n))


def extract(page: str) -> tuple[str, float, int]:
    """(text, score of the best container, paragraphs that gave points)."""
    root, nodes = parse(page)
    measure(nodes)
    gives, within = set(), set()
    for n in nodes:
        if n.parent is not None and (n.parent.order in within or n.parent.order in gives):
            within.add(n.order)
        elif n.tag in GIVES and not n.dropped and n.kept >= LEAST:
            gives.add(n.order)
    for n in reversed(nodes):  # an element's score is what it got from below before it passes half of it on
        if (up := n.parent) is not None:
            if n.order in gives:
                up.score += 1 + n.commas + min(n.kept // PER, 3)
                up.scored = True
            if n.scored:
                up.score += n.score / 2
                up.scored = True
    best, top = None, 0.0
    for n in nodes:
        if n.scored:
            n.score *= 1 - density(n)
            if n.score > top or best is None:
                best, top = n, n.score
    if best is None:
        body = next((n for n in nodes if n.tag == "body"), root)
        return "\n".join(lines(body)), 0.0, 0
    kept = []
    for s in best.parent.parts if best.parent is not None else [best]:
        if type(s) is str or s.dropped and s is not best:
            continue
        take = s is best or (s.scored and s.score >= max(10, SHARE * top))
        if not take and s.tag == "p":
            text, links = inner_text(s), density(s)
            take = (len(text) > 80 and links < 0.25) or (0 < len(text) <= 80 and links == 0 and END.search(text) is not None)
        if take:
            kept += lines(s)
    return "\n".join(kept), top, len(gives)


def extract_pages(pages: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for part in C.slices(batch, "html"):
                got = [(None, None, None) if h is None else extract(h) for h in C.column(part, "html").to_pylist()]
                text, score, count = zip(*got)
                yield pa.RecordBatch.from_arrays([C.column(part, "page_id").cast(pa.int64()), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int32())], ["page_id", "text", "score", "n_paragraphs"])

    return pages.select("page_id", "html").mapInArrow(scan, "page_id bigint, text string, score double, n_paragraphs int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
