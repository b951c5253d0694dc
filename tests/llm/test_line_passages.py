import random

from chunkwright.llm import line_dedup as L
from tests.llm.conftest import words


def brute(rows):
    """[(doc_id, text)]: lines of runs of at least two lines that came before, by plain lists."""
    seen, out = set(), {}
    for i, text in sorted({(r[0], r[1]) for r in rows}):
        lines = text.split("\n")
        gone = [False] * len(lines)
        repeats = []
        for pair in zip(lines, lines[1:]):
            repeats.append(pair in seen)
            seen.add(pair)
        k = 0
        while k < len(repeats):
            end = k
            while end < len(repeats) and repeats[end]:
                end += 1
            if end > k and "".join(lines[k : end + 1]).strip():
                gone[k : end + 1] = [True] * (end + 1 - k)
            k = end + 1
        kept = "".join(x + "\n" for x, g in zip(lines, gone) if not g)
        out[i, text] = kept if gone[-1] else kept[:-1]
    return sorted((r[0], out[r[0], r[1]]) for r in rows)


def got(df, find=L.shared):
    return sorted((r.doc_id, r.text) for r in L.dedup(df, find).collect())


def test_short_passages_in_any_context(spark, docs):
    rng = random.Random(8)
    own = lambda: [" ".join(words(rng, 6)) for _ in range(rng.randint(1, 9))]
    passages = [[" ".join(words(rng, 8)) for _ in range(n)] for n in (2, 2, 3, 3, 4, 4, 9)]
    rows, left = [], []
    for i in range(80):
        before, after = own(), own()
        rows.append((i, "\n".join([*before, *passages[i % 7], *after]), "en", "s", 1))
        left.append((i, "\n".join([*before, *(passages[i % 7] if i < 7 else []), *after])))
    df = spark.createDataFrame(rows, docs.schema)
    assert got(df) == left == brute(rows)
    assert got(df, L.found) != left  # equal chunks alone leave most of them


def test_overlaps_blanks_and_copies(spark, docs):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c c", "", " ", "\t"]) for _ in range(rng.randint(1, 12))), "en", "s", 1) for i in range(60)]
    rows += [rows[3], (60, "x\ny", "en", "s", 1), (61, "x\ny", "en", "s", 1), (62, "q\nx\ny", "en", "s", 1), (63, "x\ny\nq", "en", "s", 1), (64, "\n\n\n", "en", "s", 1)]
    assert got(spark.createDataFrame(rows, docs.schema)) == brute(rows)


def test_counts_and_bytes(spark, docs):
    rows = [(1, "a\nb\nc\nd", "en", "s", 1), (2, "a\nb\né\nc\nd", "en", "s", 1)]
    assert [(r.text, r.removed_chunks, r.removed_bytes) for r in L.dedup(spark.createDataFrame(rows, docs.schema), L.shared).orderBy("doc_id").collect()] == [("a\nb\nc\nd", 0, 0), ("é\n", 2, 7)]


def test_different_bytes_of_one_hash_stay(spark, docs):
    def one_hash(text):
        for _, _, begin, end, nth in L.shared(text):
            yield 7, 7, begin, end, 0

    rows = [(1, "a\nb", "en", "s", 1), (2, "c\nd", "en", "s", 1)]
    assert got(spark.createDataFrame(rows, docs.schema), one_hash) == [(1, "a\nb"), (2, "c\nd")]


def test_nasty(spark, nasty):
    out = L.dedup(nasty, L.shared)
    assert out.count() == nasty.count() and set(out.columns) == set(nasty.columns)
    assert {(None, "a text without an id of some words here"), (1, None), (2, ""), (9, ""), (11, "\n" * 500)} <= {(r.doc_id, r.text) for r in out.collect()}


def test_query_takes_passages(spark, tmp_path, docs):
    rows = [(1, "o\nx\ny\np", "en", "s", 1), (2, "q\nx\ny\nr", "en", "s", 1)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.text) for r in L.query(spark, str(tmp_path)).collect()) == [(1, "o\nx\ny\np"), (2, "q\nr")]
