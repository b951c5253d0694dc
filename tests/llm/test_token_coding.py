import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.llm import token_coding as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_000, 66_000), max_size=40))
def test_round_trip(values):
    c, d = K.encode(np.array(values, np.uint32))
    assert len(c) == -(-len(values) // 4) and K.decode(c, d, len(values)).tolist() == values


def test_bytes():
    c, d = K.encode(np.array([1, 256, 65_536, 2**24, 5], np.uint32))
    assert c == bytes([0 | 1 << 2 | 2 << 4 | 3 << 6, 0]) and len(d) == 1 + 2 + 3 + 4 + 1


@pytest.fixture(scope="module")
def tokenizer():
    with open(K.VOCABULARY, "rb") as f:
        return K.Tokenizer(f.read())


def test_same_ids_as_the_library(tokenizer, corpus):
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "é", "'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "1", "²", "!", "。", " ", "　", "𝒳", "🙂", "I'm", "x's'", "''s", " 's", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [r[1] for r in corpus]
    ids, at = tokenizer.encode(pa.array(texts))
    for text, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == tokenizer.encoding.encode_ordinary(text)


def read_back(rows, tokenizer):
    (d,) = [r for r in rows if r.kind == "dictionary"]
    order = K.decode(bytes(d.control), bytes(d.data), d.n_tokens)
    return order, [(r.doc_id, None if r.control is None else tokenizer.encoding.decode(order[K.decode(bytes(r.control), bytes(r.data), r.n_tokens)].tolist())) for r in rows if r.kind == "document"]


def test_corpus(docs, corpus, tokenizer):
    order, back = read_back(K.encode_corpus(docs).collect(), tokenizer)
    assert sorted(back) == sorted((r[0], r[1]) for r in corpus)
    count = Counter(t for r in corpus for t in tokenizer.encoding.encode_ordinary(r[1]))
    assert order.tolist() == sorted(range(tokenizer.size), key=lambda t: (-count[t], t))


def test_nasty(nasty, tokenizer):
    _, back = read_back(K.encode_corpus(nasty).collect(), tokenizer)
    assert sorted(back, key=repr) == sorted(((r.doc_id, r.text) for r in nasty.collect()), key=repr)
    order, back = read_back(K.encode_corpus(nasty.limit(0)).collect(), tokenizer)
    assert back == [] and order.tolist() == list(range(tokenizer.size))


def test_pieces_of_one_hash_are_told_apart(tokenizer, monkeypatch):
    texts = pa.array(["some words and more words, of another text", "words"])
    want = [x.tolist() for x in tokenizer.encode(texts)]
    monkeypatch.setattr(K, "hash_spans", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert [x.tolist() for x in tokenizer.encode(texts)] == want
