import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwright.functions.hashing import GEAR
from chunkwright.operators import index as X
from chunkwright.operators.chunking import SMALL, ChunkConfig, chunk, cuts, sequential_cuts

A2 = b"shared payload block\n" * 10000
BASE, SHARED = b"0123456789abcdef" * 4096, b"common-region-" * 20000
A3 = BASE + SHARED + BASE
CONFIGS = [SMALL, ChunkConfig(), ChunkConfig(64, 256, 1024), ChunkConfig(10, 1, 100), ChunkConfig(500, 64, 400), ChunkConfig(2, 1024, 4096)]


def frame(spark, contents):
    return spark.createDataFrame(list(enumerate(map(bytearray, contents))), "doc_id bigint, content binary")


def test_gear_table():
    assert hashlib.md5(b"".join(int(g).to_bytes(8, "big") for g in GEAR)).hexdigest() == "27565fb55e9188b956fa2af8be38ff5b"


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 4095, 4096, 4097, 30000])
def test_vectorised_is_sequential(cfg, n):
    for data in (os.urandom(n), b"a" * n):
        ends = cuts(data, cfg)
        assert ends == sequential_cuts(data, cfg)
        assert (ends[-1] if ends else 0) == n


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_size_bounds(data):
    cfg = ChunkConfig(16, 64, 256)
    ends = cuts(data, cfg)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(0 < s <= 256 for s in sizes) and all(s > 16 for s in sizes[:-1])


def test_bad_config():
    with pytest.raises(ValueError):
        ChunkConfig(512, 1000, 4096)


def test_known_figures(spark):
    one = chunk(frame(spark, [b"abcdef0123456789" * 4096 + b"tail" * 128]), "doc_id", "content", SMALL)
    assert (one.count(), one.select("digest").distinct().count()) == (17, 2)
    t = X.totals(chunk(frame(spark, [A2, A2]), "doc_id", "content", SMALL)).first()
    assert (t.files, t.total_refs, t.unique_chunks, t.duplicate_refs, t.logical_bytes, t.unique_bytes) == (2, 104, 22, 82, 420000, 87120)
    t = X.totals(chunk(frame(spark, [A3, b"prefix-shift" + A3]), "doc_id", "content", SMALL)).first()
    assert (t.total_refs, t.unique_chunks, t.duplicate_refs, t.logical_bytes, t.unique_bytes) == (202, 15, 187, 822156, 56204)


def test_delete_and_collect(spark):
    c = chunk(frame(spark, [b"unique-data-" * 10000]), "doc_id", "content", SMALL)
    assert c.count() == 30
    kept, dead = X.collect_garbage(X.delete(X.index(c), c, F.col("doc_id") == 0))
    assert tuple(dead.first()) == (4, 13504) and kept.count() == 0


def test_null_and_empty_contents(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"x"))], "doc_id bigint, content binary")
    assert [tuple(r)[:4] for r in chunk(df, "doc_id", "content", SMALL).collect()] == [(3, 0, 0, 1)]
    assert chunk(df.limit(0), "doc_id", "content", SMALL).count() == 0
    t = X.totals(chunk(df.limit(0), "doc_id", "content", SMALL)).first()
    assert (t.unique_chunks, t.unique_bytes, t.dedup_ratio) == (0, 0, 1.0)


def test_order_of_ingest_does_not_matter(spark):
    a, b = frame(spark, [A2]), frame(spark, [A3]).withColumn("doc_id", F.lit(7).cast("bigint"))
    ca, cb = (chunk(x, "doc_id", "content", SMALL) for x in (a, b))
    merged = X.merge(X.index(ca), X.index(cb)).select("digest", "refcount")
    both = X.index(ca.unionByName(cb)).select("digest", "refcount")
    assert sorted(merged.collect()) == sorted(both.collect())


def test_lru_layers(spark):
    rows = [(0, i, 0, 1, d) for i, d in enumerate("abacaabc")]
    c = spark.createDataFrame(rows, "doc_id bigint, ordinal bigint, file_offset bigint, size bigint, digest string")
    big = [r.layer for r in X.layers_lru(c, None, 100).orderBy("ordinal").collect()]
    assert big == ["miss", "miss", "hot", "miss", "hot", "hot", "hot", "hot"] or big == [r.layer for r in X.layers(c).orderBy("ordinal").collect()]
    assert [r.layer for r in X.layers_lru(c, None, 2).orderBy("ordinal").collect()] == ["miss", "miss", "hot", "miss", "hot", "hot", "cold", "cold"]
