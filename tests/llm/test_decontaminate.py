import random

import pytest

from chunkwright.llm import decontaminate as D
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, 25)).capitalize() + ". " + " ".join(words(rng, 9)).capitalize() + ".") for k in range(30)]
    items += [(100, None), (101, ""), (102, "single"), (103, "one sentence of a few words only")]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


def brute_scores(index, h, ptr, t):
    """Every passage against every item."""
    out = set()
    for i in range(len(ptr) - 1):
        w = h[ptr[i] : ptr[i + 1]]
        for k in range(0, len(w), D.PASSAGE // 2):
            known = set(index.lookup(w[k : k + D.PASSAGE]).tolist()) - {len(index.terms)}
            scores = {}
            for term in known:
                for _, block in index.blocks[term].values():
                    for item, x in block:
                        scores[item] = scores.get(item, 0) + x
            out |= {(i, k, item) for item, s in scores.items() if s >= t - 1e-9}
    return out


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8])
def test_wand_retrieves_all(bench, corpus, t):
    import pyarrow as pa

    from chunkwright.llm.textscan import scan_words

    (index,) = D.build(bench[0], t)
    rng = random.Random(2)
    texts = [r[1] for r in corpus] + [" ".join(words(rng, rng.randint(0, 400)) + rng.choice(bench[1][:30])[1].split()[: rng.randint(5, 40)] + words(rng, 30)) for _ in range(60)]
    w = scan_words(pa.array(texts))
    got = {(a, b, item) for a, b, found in index.search(w.hashes, w.ptr, t) for item, _ in found}
    assert got == brute_scores(index, w.hashes, w.ptr, t) and got


def test_leaks(spark, docs, corpus, bench):
    items = dict(bench[1][:30])
    planted = [(1000 + k, corpus[k][1] * 3 + items[k].upper() + " " + corpus[k + 1][1], "en", "s", 1) for k in range(30)]
    half = [(2000 + k, corpus[k][1] + " " + " ".join(items[k].split()[:12]), "en", "s", 1) for k in range(30)]  # no answer
    df = spark.createDataFrame(corpus + planted + half, docs.schema)
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench[0]).collect()}
    assert got == {(1000 + k, k) for k in range(30)}
    left = D.drop_leaks(df, bench[0])
    assert left.columns == df.columns and left.count() == df.count() - 30


def test_shards_give_the_same(docs, bench, monkeypatch, spark, corpus):
    df = spark.createDataFrame(corpus[:5] + [(7, bench[1][3][1], "en", "s", 1)], docs.schema)
    one = sorted(map(tuple, D.leaks(df, bench[0]).collect()))
    monkeypatch.setattr(D, "SHARD", 7)
    assert sorted(map(tuple, D.leaks(df, bench[0]).collect())) == one and one


def test_nasty(nasty, bench):
    assert D.leaks(nasty, bench[0]).count() == 0
    left = D.drop_leaks(nasty, bench[0])
    assert left.columns == nasty.columns and left.count() == nasty.count()
    assert D.leaks(nasty.limit(0), bench[0]).count() == 0
    assert D.leaks(nasty, bench[0].limit(0)).count() == 0 and D.drop_leaks(nasty, bench[0].limit(0)).count() == nasty.count()


def test_items_of_one_or_two_words_are_no_leaks(spark, docs):
    items = spark.createDataFrame([(1, "cat"), (2, "the cat"), (3, "the cat sat")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "hello the cat sat here", "en", "s", 1), (2, "hello the cat here", "en", "s", 1), (3, "cat", "en", "s", 1)], docs.schema)
    assert [(r.doc_id, r.item_id) for r in D.leaks(df, items).collect()] == [(1, 3)]
    assert {r.doc_id for r in D.drop_leaks(df, items).collect()} == {2, 3}


def test_many_items_take_one_scan(spark, docs, corpus):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, 12)) + ". " + " ".join(words(rng, 4)) + ".") for k in range(5000)]
    df = spark.createDataFrame(corpus[:20] + [(5000 + k, items[k * 499][1], "en", "s", 1) for k in range(10)], docs.schema)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for out in (D.leaks(df, bench), D.drop_leaks(df, bench)):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()} == {(5000 + k, k * 499) for k in range(10)}
