import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, copies, near copies, repeats, long and short ones."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr", "es")[i % 4]
        letters = {"en": "abcdefgh", "de": "äöüßklmn", "fr": "éèçàopqr", "es": "ñíóústuv"}[lang]
        w = words(rng, rng.randint(5, 200), letters)
        text = ""
        for k, x in enumerate(w):
            text += x + ("\n" if k % 9 == 8 else " ")
        rows.append((i, text, lang, f"src{i % 18}", len(text)))
    for i in range(120, 160):  # near and exact copies
        base = rows[i % 30]
        w = base[1].split(" ")
        for _ in range(0 if i % 4 == 0 else max(1, len(w) // 30)):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((i, " ".join(w), base[2], base[3], base[4]))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
NASTY = [
    (1, None, "en", "src0", 3),
    (2, "", "en", "src1", 0),
    (3, " \n\t \r\n", "de", "src2", 5),
    (None, "a text without an id of some words here", "en", "src0", 30),
    (5, "one", None, "src0", 3),
    (6, "two words", "fr", None, None),
    (7, "word after word " * 20_000, "en", "src0", 1),
    (8, "the same row twice and again\nwith a second line\nand a third one", "es", "src5", 1),
    (8, "the same row twice and again\nwith a second line\nand a third one", "es", "src5", 1),
    (8, "another text under the same id", "es", "src5", 1),
    (9, "the same row twice and again\nwith a second line\nand a third one", "es", "src5", 1),
    (10, "!!! ??? ... 🙂", "en", "src6", 1),
    (11, "\n" * 500, "en", "src6", 1),
    (-12, "Ümläut ñandú 漢字 \u0000 nul", "de", "src7", 1),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """With columns that are called like ones the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(NASTY, SCHEMA)
    for name in ("shard", "epoch", "removed_chunks", "removed_bytes", "score", "language", "sig", "size", "domain", "bucket", "jaccard", "group", "kind", "_own", "_sig", "_doc_id", "_spans", "spans", "hash", "_cut", "_epochs", "_domain", "_times", "place", "links", "rep"):
        df = df.withColumn(name, F.lit("mine"))
    return df
