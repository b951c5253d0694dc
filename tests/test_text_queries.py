import random
import re

import pytest

from chunkwright.operators import textprep as X
from chunkwright.plans import text_queries as Q
from chunkwright.sources import files as S

DOCUMENTS = "doc_id bigint, text string"


@pytest.fixture
def written(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def by_depth(text):
    """What is at depth 0, sign by sign; braces that open or close count in twos from the left."""
    out, depth, i = "", 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "{{":
            depth, i = depth + 1, i + 2
        elif two == "}}" and depth:
            depth, i = depth - 1, i + 2
        else:
            out += text[i] if depth == 0 else ""
            i += 1
    return out


def test_templates_of_all_documents(spark, written):
    rng = random.Random(2)
    texts = ["a {{b {{c}} d}} e", "a {{b", "a }} b {{c}} d", "{{{x}}}", "no braces", "", "{{a}}{{b}}", "é {{ü {{ñ}}}} 漢"]
    texts += ["".join(rng.choice(["{", "{{", "}", "}}", "a", "\n"]) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(-1, None)]
    got = dict(Q.remove_templates(spark, written("documents", rows, DOCUMENTS)).collect())
    assert got == {i: None if x is None else by_depth(x) for i, x in rows}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["remove_templates", "remove_nested_templates", "length_filter"])
def test_templates_go_without_python(spark, written, name):
    assert "Python" not in plan(Q.R.queries[name](spark, written("documents", [(1, "a {{b}} c")], DOCUMENTS)))


def test_texts_are_cleaned_once(spark, written):
    pages = spark.createDataFrame([("a", "x" * 500)], "title string, text string")
    for df in (Q.length_filter(spark, written("documents", [(1, "x" * 500)], DOCUMENTS)), S.clean_articles(pages)):
        assert plan(df).count("https?") == 1


def test_templates_of_long_texts(spark, written):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["{{", "}}", "{", "}", "a", "é\n", "\U0001d4b3"]) for _ in range(n)) for n in [15, 16, 17, 31, 32, 33, 255, 256, 257, 511, 512, 513, 5000] for _ in range(8)]
    texts += ["{{" * 600 + "x" + "}}" * 600 + "y", "}}" * 600 + "{{x}}y", "{{" * 600 + "x", "{{x}}y" * 700]
    rows = list(enumerate(texts))
    got = dict(Q.remove_templates(spark, written("documents", rows, DOCUMENTS)).collect())
    assert got == {i: by_depth(x) for i, x in rows}


def test_articles_of_all_pages(spark, written):
    rows = [(1, "u", "<p>odd</p>"), (2, "u", "<p>even</p>"), (3, " ", "no title"), (4, "u", "<p> </p>"), (5, "u", " #redirect x"), (6, "u", "see #redirect"), (7, "u", "<b>#REDIRECT</b>"), (9, "u", "''nine''")]
    got = Q.article_filter(spark, written("pages", rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.chars) for r in got) == [(1, 3), (2, 4), (6, 13), (9, 4)]


def test_other_namespaces_are_no_articles(spark):
    df = spark.createDataFrame([(k, "t", ns, "text") for k, ns in enumerate([0, 1, -1, 14, None])], "k int, title string, ns int, text string")
    assert [r.k for r in df.where(X.is_article(df.title, df.ns, df.text)).collect()] == [0]


def test_length_of_all_cleaned_documents(spark, written):
    rows = [(i, "x" * (499 + i % 2)) for i in range(1000)] + [(1000, "x" * 400 + "{{" + "y" * 200 + "}}"), (1001, "x" * 400 + "<" + "b" * 200 + ">"), (1002, "''" + "x" * 500 + "''"), (1003, None)]
    got = dict(Q.length_filter(spark, written("documents", rows, DOCUMENTS)).collect())
    assert got == {i: 500 for i in [*range(1, 1000, 2), 1002]}


def test_limit_counts_what_is_kept(spark):
    pages = spark.createDataFrame([("d", "x" * 600), ("a", "short"), ("c", "x" * 500), ("b", "x" * 400 + "{{" + "y" * 200 + "}}"), ("e", "x" * 700)], "title string, text string")
    assert [r.title for r in S.clean_articles(pages, limit=2).collect()] == ["c", "d"]
    assert S.clean_articles(pages).count() == 3


def test_markup_by_python(spark):
    rng = random.Random(5)
    texts = ["== a head ==", "=======x===", "a == b", "[[link|label]] [[only]] [[a|b|c]]", "[http://x.y/z a label] [https://x ] [http://q]", 3 * "'" + "bold" + 3 * "'" + " it's", "\u2003 blank\u00a0", "a\n\n\n\nb", "<b>x</b> < y > z", "=={}==".format("\n"), ""]
    texts += ["".join(rng.choice(["==", "=", "[[", "]]", "|", "a", " ", "'", "''", "<", ">", "\n\n", "[http://a.b ", "]"]) for _ in range(rng.randint(1, 25))) for _ in range(400)]

    def by_python(text):
        text = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", text)
        text = re.sub(r"\[https?://\S+\s+([^\]]+)\]", r"\1", text)
        for pattern, to in (("={2,}([^=]+)={2,}", r"\1"), ("'{2,}", ""), ("<[^>]+>", ""), ("\n{3,}", "\n\n")):
            text = re.sub(pattern, to, text)
        return text.strip()

    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert dict(df.select("k", X.strip_markup(df.text)).collect()) == {k: by_python(x) for k, x in enumerate(texts)}


def test_lines_are_measured_with_their_ends(spark):
    rng = random.Random(6)
    texts = ["x" * 40 + "\n" + "y" * 40 + "\r\n" + "z" * 39 + "\r" + "w" * 39 + "\n", "a" * 60 + "\u2028" + "b" * 60, "", "\n\n"]
    texts += ["".join(rng.choice(["abc " * 12, "short", "\n", "\r", "\r\n", "\x0b", "\x85", "\x1d"]) for _ in range(30)) for _ in range(50)]

    def by_python(text):
        return "".join(x[: len(x) // 2] + "<>" + x[len(x) // 2 :] if len(x) > 40 else x for x in text.splitlines(keepends=True))

    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert dict(df.select("k", X.mutate_lines(df.text, df.k, 1.0, "<>")).collect()) == {k: by_python(x) for k, x in enumerate(texts)}
