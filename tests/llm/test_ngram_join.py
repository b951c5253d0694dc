import re

import numpy as np
import pytest

from chunkwright.llm import ngram_join as J

WORD = re.compile("[0-9a-zÀ-῿₀-⿿぀-\U0010ffff]+")


def grams(text, n=J.N):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, t, n=J.N):
    sets = {}
    for i, text in rows:
        if i is not None and (g := grams(text, n)):
            sets.setdefault(g, set()).add(i)
    out = {(min(ids), i): 1.0 for ids in sets.values() for i in ids if i != min(ids)}
    nodes = [(min(ids), g) for g, ids in sets.items()]
    for k, (a, x) in enumerate(nodes):
        for b, y in nodes[:k]:
            j = len(x & y) / len(x | y)
            if j >= t - 1e-9 and a != b:
                out[min(a, b), max(a, b)] = j
    return out


def as_dict(df):
    rows = df.collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return {(r[0], r[1]): pytest.approx(r[2], abs=1e-12) for r in rows}


@pytest.mark.parametrize("n,t", [(2, 0.6), (3, 0.5), (1, 0.9)])
def test_all_pairs(docs, corpus, n, t):
    want = brute([(r[0], r[1]) for r in corpus], t, n)
    assert len(want) > 10
    assert as_dict(J.ngram_join(docs, n, t)) == want


def test_nasty(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert as_dict(J.ngram_join(nasty)) == brute(rows, J.THRESHOLD)


def test_empty(nasty):
    assert J.ngram_join(nasty.limit(0)).count() == 0


def brute_classes(rows, t=J.THRESHOLD, n=J.N):
    """(class_id, links, copies) of each doc_id, by comparing all sets."""
    own = {i: set() for i, _ in rows if i is not None}
    for i, text in rows:
        if i is not None and (g := grams(text, n)):
            own[i].add(g)
    holders = {}
    for i, sets in own.items():
        for g in sets:
            holders.setdefault(g, set()).add(i)
    near = {g: {h for h in holders if h != g and len(g & h) / len(g | h) >= t - 1e-9} for g in holders}
    out = {}
    for i in own:
        seen, todo = {i}, [i]
        while todo:
            for g in own[todo.pop()]:
                for x in set().union(holders[g], *(holders[h] for h in near[g])) - seen:
                    seen.add(x), todo.append(x)
        out[i] = (min(seen), sum(len(near[g]) for g in own[i]), sum(len(holders[g]) - 1 for g in own[i]))
    return out


def as_classes(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and df.columns == ["doc_id", "class_id", "links", "copies"]
    return {r.doc_id: (r.class_id, r.links, r.copies) for r in rows}


def test_classes(docs, corpus, nasty):
    want = brute_classes([(r[0], r[1]) for r in corpus])
    assert len({c for c, *_ in want.values()}) < len(want) and as_classes(J.classes(docs)) == want
    assert as_classes(J.classes(nasty)) == brute_classes([(r.doc_id, r.text) for r in nasty.collect()])
    assert J.classes(nasty.limit(0)).count() == 0


def test_hot_tokens_meet_in_parts(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    assert as_dict(J.ngram_join(docs, hot=1)) == as_dict(J.ngram_join(docs, hot=3)) == brute(rows, J.THRESHOLD)


def test_one_of_each_group_stays(spark, docs):
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 9)] + [(20, 30, 1.0), (30, 25, 1.0)], "doc_a bigint, doc_b bigint, jaccard double")
    got = {r.doc_id: r.group for r in J.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20, 30: 20, 25: 20}
    classes = J.components(pairs).withColumnRenamed("group", "class_id")
    left = {r.doc_id for r in J.drop_near_copies(docs, classes).collect()}
    assert left == set(range(160)) - set(range(1, 10)) - {25, 30}
    assert J.components(pairs.limit(0)).count() == 0


def test_a_group_of_copies_costs_one_pair_each(spark):
    df = spark.createDataFrame([(i, "a group of copies of one text only") for i in range(300)], "doc_id bigint, text string")
    assert J.ngram_join(df).count() == 299
    assert as_classes(J.classes(df)) == {i: (0, 0, 299) for i in range(300)}


def test_filters_never_drop_a_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        ys = [np.unique(np.r_[x[rng.random(len(x)) < 0.8], rng.integers(0, 60, rng.integers(1, 9))]).astype(np.uint64) for _ in range(5)]
        sizes = np.array([len(y) for y in ys])
        low = J.suffix_bounds(x, np.concatenate(ys), np.cumsum(sizes) - sizes, sizes)
        for y, got, bound in zip(ys, J.similarities(x, ys, 0.6), low):
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            assert got == pytest.approx(j) if j >= 0.6 else got < 0.6
            assert bound <= len(x) + len(y) - 2 * len(np.intersect1d(x, y))


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 70_000):
        x = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert (J.unpack_set(J.pack_set(x), len(x)) == x).all()
    col = {f: rng.integers(0, 250, 7 if k < J.BY_SET else 31).astype(kind) for k, (f, kind) in enumerate(J.KINDS)}
    got = J.unpack_rows(J.pack_rows(col))
    assert all((got[f] == col[f]).all() for f in col)


def test_blocks_of_a_hub_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 1)
    assert as_dict(J.ngram_join(docs)) == brute([(r[0], r[1]) for r in corpus], J.THRESHOLD)
