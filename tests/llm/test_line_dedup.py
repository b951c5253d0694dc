import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.llm import line_dedup as L
from tests.llm.conftest import words


def brute_chunks(text):
    """Lists of lines."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        roll = h[i] + 31 * (h[i - 1] if i > 0 else 0) + 961 * (h[i - 2] if i > 1 else 0)
        if roll % L.EVERY == 0 or len(now) == L.MOST:
            out.append(now)
            now = []
    return out + [now] * bool(now)


def brute(rows):
    """[(doc_id, text, removed)] in the order of rows."""
    first, seen_rows = {}, set()
    order = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}, key=lambda r: r[0])
    for i, text in order:
        for k, c in enumerate(brute_chunks(text)):
            if len(c) >= L.LEAST and "\n".join(c).strip(" \t\r\n"):
                first.setdefault("\n".join(c), (i, text, k))
    out = []
    for i, text, *_ in rows:
        if i is None or not text:
            out.append((i, text, 0))
            continue
        kept, removed, chunks = [], 0, brute_chunks(text)
        firsts_here = {}
        for k, c in enumerate(chunks):
            body = "\n".join(c)
            f = first.get(body)
            gone = f is not None and (f[0] != i or firsts_here.setdefault(body, k) != k)
            removed += gone
            kept.append((gone, c))
        joined = "".join("\n".join(c) + "\n" for gone, c in kept if not gone)
        out.append((i, joined if kept[-1][0] else joined[:-1], removed))
    return out


def check(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.text, r.removed_chunks) for r in L.dedup(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    return sum(r[2] for r in got)


def test_repeated_passages(spark, docs):
    rng = random.Random(3)
    passages = [[" ".join(words(rng, 8)) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(60):
        own = [" ".join(words(rng, 6)) for _ in range(rng.randint(0, 15))]
        at = rng.randint(0, len(own))
        lines = own[:at] + passages[i % 5] * rng.randint(0, 2) + own[at:]
        rows.append((i, "\n".join(lines), "en", "s", 1))
    assert check(spark, rows, docs.schema) > 50


def test_nasty(spark, nasty):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in nasty.collect()]
    check(spark, [r for r in rows if not (r[0] == 8 and r[1].startswith("another"))], nasty.select("doc_id", "text", "lang", "source", "n_chars").schema)
    out = L.dedup(nasty)
    assert out.count() == nasty.count() and set(out.columns) == set(nasty.columns)
    others = [c for c, kind in nasty.dtypes[5:] if c not in ("removed_chunks", "removed_bytes")]
    assert all(r[c] == "mine" for r in out.collect() for c in others)
    assert L.dedup(nasty.limit(0)).count() == 0
    got = {(r.doc_id, r.text) for r in out.collect() if r.doc_id in (None, 1, 2)}
    assert {(1, None), (2, ""), (None, "a text without an id of some words here")} == got


def test_different_bytes_of_one_hash(spark, docs):
    texts = ["a\nb\nc\nd\ne\nf", "g\nh\ni\nj\nk\nl", "a\nb\nc\nd\ne\nf"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], docs.schema)
    want = sorted((r[0], r[1]) for r in brute([(i, t) for i, t in enumerate(texts)]))
    assert want[2] != (2, texts[2])
    half = lambda text: ((7, *x[1:]) for x in L.found(text))
    assert sorted((r.doc_id, r.text) for r in L.dedup(df, half).collect()) == want
    both = lambda text: ((7, 7, *x[2:]) for x in L.found(text))
    assert sorted((r.doc_id, r.text) for r in L.dedup(df, both).collect()) == list(enumerate(texts))


def test_two_texts_of_one_id(spark, docs):
    """The one of the lesser md5 keeps what they share."""
    rows = [(1, "a\nb\nx", "en", "s", 1), (1, "y\na\nb", "en", "s", 1)]
    got = sorted(r.text for r in L.dedup(spark.createDataFrame(rows, docs.schema), L.shared).collect())
    assert got in (["a\nb\nx", "y\n"], ["x", "y\na\nb"])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n ", max_size=200))
def test_chunks_tile_the_text(text):
    raw = text.encode()
    parts = [raw[a:b] for a, b, _ in L.chunks(raw)]
    assert b"\n".join(parts) == raw
    assert [p.decode() for p in parts] == ["\n".join(c) for c in brute_chunks(text)]


def test_ends_do_not_shift():
    rng = random.Random(1)
    lines = [" ".join(words(rng, 5)) for _ in range(200)]
    body = lambda x: {"\n".join(c) for c in brute_chunks("\n".join(x))}
    a, b = body(lines), body(lines[:100] + ["a line put in"] + lines[100:])
    assert len(a - b) <= 4
