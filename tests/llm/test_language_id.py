import numpy as np
import pyarrow as pa
import pytest

from chunkwright.llm import language_id as L


@pytest.fixture(scope="module")
def net(corpus):
    return L.train([r[1] for r in corpus[:80]], [r[2] for r in corpus[:80]], epochs=30)


def test_gradients_by_differences():
    net = L.new_network(["a", "b", "c"], 1)
    for w in net.parameters():
        w += np.random.default_rng(3).normal(0, 0.05, w.shape).astype(np.float32)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, [w.astype(np.float64) for w in getattr(net, name)] if isinstance(getattr(net, name), list) else getattr(net, name).astype(np.float64))
    loss = lambda: -net.log_probabilities(net.pooled(x)[0])[np.arange(6), y].mean()
    for w, g in zip(net.parameters(), L.gradients(net, x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-6
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_tables_are_the_network(net, corpus):
    x, _, _ = L.windows_of(*L.text_bytes(pa.array([r[1] for r in corpus[:20]])))
    assert np.allclose(L.Tables(net).pooled(x), net.pooled(x)[0], atol=1e-4)


def test_windows_cover_the_whole_text():
    data, at = L.text_bytes(pa.array(["a" * 1000, "", "b"]))
    x, owner, filled = L.windows_of(data, at)
    assert owner.tolist() == [0, 0, 0, 0, 2] and filled.tolist() == [256, 256, 256, 232, 1] and (x > 0).sum() == 1001


def test_held_out_accuracy(net, corpus):
    lang, _, accepted = L.decide(L.Tables(net), pa.array([r[1] for r in corpus[80:]]), L.MIN_PROB)
    right = [g == r[2] for g, r in zip(lang.to_pylist(), corpus[80:])]
    assert np.mean(right) >= 0.95 and np.mean(accepted.to_pylist()) > 0.95


def test_nasty(nasty, net):
    tables = L.Tables(net)
    got = L.identify(nasty, tables).collect()
    assert len(got) == nasty.count()
    rejected = [r for r in got if not r.accepted]
    assert {1, 2, 3, 11} <= {r.doc_id for r in rejected} and all(r.language is None for r in got if r.doc_id in (1, 2, 3, 11))
    left = L.keep_identified(nasty, tables)
    assert left.columns == nasty.columns and left.count() == len(got) - len(rejected)
    assert L.identify(nasty.limit(0), L.fit(nasty.limit(0))).count() == 0
    assert L.keep_identified(nasty.limit(0), None).count() == 0
    with pytest.raises(ValueError):
        L.fit(nasty.where("lang is null"))


def test_same_sample_however_partitioned(docs):
    a, b = L.labelled_sample(docs, 5), L.labelled_sample(docs.repartition(7), 5)
    assert sorted(zip(*a)) == sorted(zip(*b)) and len(a[0]) == 20
