import re
import time
from html.parser import HTMLParser

import pytest

from chunkwright.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><p>Home, about, contact, links, and more of the same, with commas, many.</p></nav>
<div id="side"><p>A short aside, <a href="x">with a link, and words that are long enough</a></p></div>
<!-- a comment with <p>a paragraph, inside, of it that is long enough</p> -->
<script>var t = "<p>not, text, at all, of any kind here</p>";</script>
<article><h1>Title</h1><p>The first paragraph, which has some commas, and words &amp; more.<p>The second one, <b>bold</b>, also
 with commas, and a line break.</p><ul><li>An item, of enough length, to count</ul><table><tr><td>cell one<td>cell two</table></article>
<footer><p>Footer, with commas, and all, that should not be taken at all.</p></footer></body></html>"""


def test_page():
    text, score, n = H.extract(PAGE)
    assert text.split("\n") == ["Title", "The first paragraph, which has some commas, and words & more.", "The second one, bold, also with commas, and a line break.", "An item, of enough length, to count", "cell one", "cell two"]
    assert n == 4 and score > 0


class Tree(HTMLParser):
    """A second parser for well-formed pages: nested dicts."""

    def __init__(self):
        super().__init__()
        self.root = {"tag": "root", "kids": [], "up": None}
        self.now = self.root

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": [], "up": self.now}
        self.now["kids"].append(node)
        if tag != "br":
            self.now = node

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, data):
        self.now["kids"].append(data)


def chars(node, link=False, gone=False):
    """(all, in links, kept, commas kept) characters, by the definition."""
    link, gone = link or node["tag"] == "a" or node["tag"] in H.DROP, gone or node["tag"] in H.DROP
    out = [0, 0, 0, 0]
    for k in node["kids"]:
        if isinstance(k, str):
            n = len(re.sub(r"\s+", " ", k).strip())
            more = (n, n * link, n * (not gone), k.count(",") * (not gone))
        else:
            more = chars(k, link, gone)
        out = [x + y for x, y in zip(out, more)]
    return out


def text_lines(node, top=True):
    """Text with marks where lines end."""
    if node["tag"] in H.DROP and not top:
        return ""
    if node["tag"] == "br":
        return "\0"
    body = "".join(re.sub(r"\s+", " ", k) if isinstance(k, str) else text_lines(k, False) for k in node["kids"])
    return f"\0{body}\0" if node["tag"] in H.BLOCK else body


def split(marked):
    return [x for x in (re.sub(r"\s+", " ", x).strip() for x in marked.split("\0")) if x]


def brute(page):
    """(text, best score, paragraphs) of a well-formed page, each rule read off the description."""
    t = Tree()
    t.feed(page)
    scores, nodes, given = {}, [], 0

    def walk(n, dropped, within):
        nonlocal given
        nodes.append(n)
        dropped = dropped or n["tag"] in H.DROP
        _, _, kept, commas = chars(n)
        if n["tag"] in H.GIVES and not dropped and not within and kept >= H.LEAST:
            given, within = given + 1, True
            up, share = n["up"], 1.0
            while up:
                scores[id(up)] = scores.get(id(up), 0) + share * (1 + commas + min(kept // 100, 3))
                up, share = up["up"], share / 2
        for k in n["kids"]:
            if not isinstance(k, str):
                walk(k, dropped, within)

    walk(t.root, False, False)

    def dense(n):
        total, linked, *_ = chars(n, any(x["tag"] == "a" for x in above(n)), False)
        return linked / total if total else 0

    def above(n):
        while n["up"]:
            n = n["up"]
            yield n

    final = {id(n): scores[id(n)] * (1 - dense(n)) for n in nodes if id(n) in scores}
    if not final:
        body = next((n for n in nodes if n["tag"] == "body"), t.root)
        return "\n".join(split(text_lines(body))), 0.0, 0
    best = max((n for n in nodes if id(n) in final), key=lambda n: final[id(n)])
    top, out = final[id(best)], []
    for s in best["up"]["kids"] if best["up"] else [best]:
        if isinstance(s, str) or s["tag"] in H.DROP and s is not best:
            continue
        text = " ".join(split(text_lines(s)))
        stops = re.search(r"[.!?](\s|$)", text)
        para = s["tag"] == "p" and (len(text) > 80 and dense(s) < 0.25 or 0 < len(text) <= 80 and dense(s) == 0 and stops)
        if s is best or final.get(id(s), -1) >= max(10, top / 5) or para:
            out += split(text_lines(s))
    return "\n".join(out), top, given


def test_pages_against_a_second_parser():
    """The text, the score and the number of paragraphs."""
    import random

    rng = random.Random(4)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            body = " ".join(rng.choice(["word", "longer,", "and", "comma,", "text", "end."]) for _ in range(rng.randint(1, 60)))
            if rng.random() < 0.4:
                body += f'<a href="q">{"link " * rng.randint(1, 20)}</a>'
            if rng.random() < 0.2:
                body = f"<b>{body}</b><br> after it"
            tag = rng.choice(["p", "p", "p", "pre", "blockquote"])
            return f"<{tag}>{body}</{tag}>" + rng.choice(["", " loose text ", "\n"])
        tag = rng.choice(["div", "section", "nav", "div", "blockquote", "aside"])
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    for _ in range(300):
        page = "<body>" + make(4) + make(3) + "</body>"
        text, score, given = H.extract(page)
        want = brute(page)
        assert (text, given) == (want[0], want[2]) and score == pytest.approx(want[1])


@pytest.mark.parametrize("page,want", [("", ""), ("no tags, at all", "no tags, at all"), ("<p>a < b <3 &lt;x&gt;</p>", "a < b <3 <x>"), ("</p></div>stray", "stray"), ("<script>never closed <p>x", ""), ("<p title='a>b'>q</p>", "q"), ("a<br>b", "a\nb"), ("<div>x<!-- open", "x")])
def test_small_pages(page, want):
    assert H.extract(page)[0] == want


def test_deep_and_long_pages():
    assert H.extract("<div>" * 100_000 + "<p>" + "word, " * 20)[0].startswith("word, word")
    assert len(H.extract("<p>" + "x, " * 500_000 + "</p>")[0]) > 1_000_000
    H.extract("<" * 200_000)
    H.extract("<a href=\"" * 20_000)
    began = time.perf_counter()
    for page in ("<a " * 1_000_000, "<a<" * 500_000, "<div><p>some words, of a paragraph that is long enough</p>" * 100_000, "<blockquote>x" * 100_000, "<p><button>" + "<div>" * 200_000, "<script/>" * 100_000, "<p>" + "<b>" * 100_000 + "<li>" * 50_000, "<a b='" * 200_000 + "\"" * 1000):
        H.extract(page)
    assert time.perf_counter() - began < 60


def test_query(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, PAGE), (3, PAGE), (3, PAGE)], "page_id bigint, html string").selectExpr("page_id", "html", "'mine' as text", "1 as score")
    got = H.extract_pages(df).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[1] is None and {r.page_id: r.text for r in got}[2] == ""
    assert len({r.text for r in got if r.page_id in (None, 3)}) == 1
    assert H.extract_pages(df.limit(0)).count() == 0
