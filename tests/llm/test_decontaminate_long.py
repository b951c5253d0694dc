import random

import pytest

from chunkwright.llm import decontaminate as D
from tests.llm.conftest import words


def prose(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."


@pytest.fixture(scope="module")
def items():
    rng = random.Random(6)
    return {k: prose(rng, n) + " " + prose(rng, 12) for k, n in enumerate([20, 60, 140, 240, 300, 600, 2000])}


def test_items_of_any_length_are_found(spark, docs, items, monkeypatch):
    rng = random.Random(7)
    rows, want = [], set()
    for k, text in items.items():
        for at in (0, 1, 33, 64, 500):
            own, more = words(rng, at), words(rng, 90)
            rows.append((len(rows), " ".join([*own, text.upper(), *more]), "en", "s", 1))
            want.add((rows[-1][0], k))
        w = text.split()
        rows.append((len(rows), " ".join([*words(rng, 300), *w[len(w) // 4 :]]), "en", "s", 1))  # three quarters, with the answer
        want.add((rows[-1][0], k))
        rows.append((len(rows), " ".join([*w[:-12], *words(rng, 300)]), "en", "s", 1))  # no answer
        rows.append((len(rows), " ".join([*w[: len(w) // 5], *words(rng, 300), *w[-12:]]), "en", "s", 1))  # little of it
        rows.append((len(rows), " ".join(words(rng, 700)), "en", "s", 1))
    df = spark.createDataFrame(rows, docs.schema)
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = D.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 + 1e-9 for r in got)
    assert {r.doc_id for r in D.drop_leaks(df, bench).select("doc_id").collect()} == {r[0] for r in rows} - {i for i, _ in want}
    monkeypatch.setattr(D, "SHARD", 5)  # the longest items have more pieces than a shard
    assert sorted(map(tuple, D.leaks(df, bench).collect())) == sorted(map(tuple, got))
