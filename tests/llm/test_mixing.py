import hashlib
import random
from collections import defaultdict

import pytest

from chunkwright.llm import mixing as M

WEIGHTS = (M.DOMAIN_WEIGHTS, M.LANGUAGE_WEIGHTS, M.SOURCE_WEIGHTS)


def leaf_of(lang, source):
    return (next((d for d, s in M.DOMAINS.items() if source in s), "other"), lang or "", source or "")


def count(text):
    return len([w for w in (text or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])


def brute(rows, total, max_epochs):
    leaves = defaultdict(lambda: defaultdict(int))
    for i, text, lang, source, *_ in rows:
        leaves[leaf_of(lang, source)]["" if i is None else str(i)] += count(text)
    got = M.budgets({k: sum(v.values()) for k, v in leaves.items()}, total, WEIGHTS, max_epochs)
    taken = defaultdict(int)
    for leaf, own in leaves.items():
        supply, left, epoch = sum(own.values()), got[leaf], 0
        while True:
            order = sorted(own, key=lambda i: hashlib.md5(f"{M.SEED}:{epoch}:{i}".encode()).hexdigest())
            whole = supply and left >= supply
            for i in order:
                if own[i] > left:
                    break
                left -= own[i]
                taken[leaf, i] += 1
            if not whole:
                break
            epoch += 1
    return taken


@pytest.mark.parametrize("total,epochs", [(None, 2), (1500, 1), (10**6, 3), (0, 2)])
def test_mix(docs, corpus, total, epochs):
    amount = sum(count(r[1]) for r in corpus) * 9 // 10 if total is None else total
    want = brute(corpus, amount, epochs)
    got = defaultdict(int)
    for r in M.mix(docs, total=total, max_epochs=epochs).collect():
        got[leaf_of(r.lang, r.source), str(r.doc_id)] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_nasty(nasty):
    rows = [tuple(r) for r in nasty.collect()]
    want = brute(rows, sum(count(r[1]) for r in rows) * 9 // 10, 2)
    out = M.mix(nasty)
    assert out.columns == [c for c in nasty.columns if c != "epoch"] + ["epoch"]
    got = {(leaf_of(r.lang, r.source), "" if r.doc_id is None else str(r.doc_id)) for r in out.collect()}
    assert got == {k for k, v in want.items() if v}
    assert M.mix(nasty.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first():
    supply = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("books", "en", "c"): 1000}
    got = M.budgets(supply, 300, ({"web": 2, "books": 1}, {}, {}), 1)
    assert got == {("web", "en", "a"): 10, ("web", "en", "b"): 190, ("books", "en", "c"): 100}
    got = M.budgets({**supply, ("web", "en", "b"): 50}, 300, ({"web": 2, "books": 1}, {}, {}), 1)
    assert got == {("web", "en", "a"): 10, ("web", "en", "b"): 50, ("books", "en", "c"): 240}


def test_budgets_never_exceed():
    rng = random.Random(1)
    for _ in range(200):
        supply = {(f"d{rng.randint(0, 3)}", f"l{rng.randint(0, 2)}", f"s{k}"): rng.randint(0, 100) for k in range(rng.randint(1, 12))}
        total = rng.randint(0, 600)
        got = M.budgets(supply, total, ({"d0": 3}, {"l1": 5}, {"s1": 0}), 2)
        assert all(0 <= got[k] <= 2 * v for k, v in supply.items())
        most = min(total, 2 * sum(supply.values()))
        assert most - 3 * len(supply) <= sum(got.values()) <= most or "s1" in {k[2] for k in supply}


def test_clashing_columns_keep_their_values(nasty):
    names = [c for c in nasty.columns[5:] if c != "epoch"]
    assert all(r[c] == "mine" for r in M.mix(nasty).collect() for c in names)
    out = M.mix(nasty, max_epochs=1, number_epochs=False)
    assert out.columns == nasty.columns and all(r[c] == "mine" for r in out.collect() for c in nasty.columns[5:])


def test_filling_many_leaves_takes_no_square():
    rng = random.Random(2)
    supply = {("web", "en", f"s{k}"): rng.randint(0, 1000) for k in range(50_000)}
    total = sum(supply.values()) // 2
    got = M.budgets(supply, total, ({}, {}, {}), 1)
    assert total - 50_000 <= sum(got.values()) <= total
    level = max(got.values())
    assert all(got[k] == v if v < level else got[k] == level for k, v in supply.items())
