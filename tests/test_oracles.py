"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

from chunkwright.plans import registry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    answer = duck.execute(registry.ORACLES[name])
    named = [c[0] for c in answer.description]
    assert sorted(named) == columns
    want = [tuple(plain(r[named.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
