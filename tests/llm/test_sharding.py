import hashlib

import numpy as np
import pytest

from chunkwright.llm import sharding as S


def reference(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_scalar_loop():
    keys = np.random.default_rng(0).integers(0, 2**64, 2000, dtype=np.uint64)
    for n in (1, 2, 7, 64, 1000):
        assert S.jump(keys, n).tolist() == [reference(int(k), n) for k in keys]


def test_only_the_needed_share_moves(docs):
    r = S.moved(docs, 10, 12).first()
    assert r.n_to_old == 0 and 0 < r.n_moved < r.n_rows * 0.4


def test_nasty(nasty):
    out = S.assign(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()
    for r in out.collect():
        want = -1 if r.doc_id is None else reference(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16), S.SHARDS)
        assert r.shard == want
    assert S.assign(nasty.limit(0)).count() == 0
    assert S.moved(nasty.limit(0), 2, 3).first().n_moved == 0
    with pytest.raises(ValueError):
        S.assign(nasty, 0)


def test_write(docs, tmp_path, spark):
    S.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
