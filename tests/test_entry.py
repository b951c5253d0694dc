import os

import pytest

import __spark_entry__ as entry
from chunkwright.plans import registry


def test_every_storage_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.chunks for r in rows) == 418 and sum(r.unique_chunks for r in rows) == 390
