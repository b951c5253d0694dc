"""Sharding by jump consistent hashing: a shard from the key alone, with no table of the ring.

A row's key is the first 16 hex digits of md5(key column as a string), read as an unsigned 64-bit number, so it depends
neither on the row's place nor on the engine. Growing from n to n + k shards moves the share k / (n + k) of the rows, all
of them to new shards (``moved`` reports it).

A null key has shard -1 (there is nothing stable to hash); repeated rows and ties share a shard; the text is not looked at;
every column is kept, and a column that is already called like the new one is replaced. No shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each uint64 key, all keys stepping at once; about ln(shards) steps."""
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (shard[live] + 1).astype(np.float64) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        nxt[live] = np.minimum(step, 2.0**62).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def key_of(column: str) -> Column:
    """A signed long that holds the key's 64 bits."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 16), 16, -10).cast("bigint")


def shard_of(column: str, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(of(F.coalesce(key_of(column), F.lit(0).cast("bigint"))))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    return docs.withColumn(name, shard_of(key, shards))


def moved(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """One row: rows in all, rows that change their shard, and rows that change it for an old one (0 when shards are appended)."""
    both = docs.select(shard_of(key, before).alias("a"), shard_of(key, after).alias("b"))
    return both.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("bigint")), F.lit(0)).alias("n_moved"), F.coalesce(F.sum(((F.col("a") != F.col("b")) & (F.col("b") < before)).cast("bigint")), F.lit(0)).alias("n_to_old"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Parquet in one folder a shard. Rows meet by shard and a salt, so that a large shard is written by several tasks."""
    out = assign(docs, shards, key)
    salt = F.pmod(F.xxhash64(key), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)))
    out.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
with recursive k as (select distinct doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 16))::ubigint::hugeint as key from documents where doc_id is not null),
j(doc_id, key, b, nxt) as (
  select doc_id, key, 0::bigint, 0::bigint from k
  union all
  select doc_id, k2, nxt, least(floor((nxt + 1)::double * (2147483648.0::double / (((k2 >> 33) + 1)::double))), 4e18::double)::bigint
  from (select doc_id, nxt, ((key::uhugeint * 2862933555777941757::uhugeint + 1) % 18446744073709551616::uhugeint)::hugeint as k2 from j where nxt < {SHARDS}))
select d.*, coalesce(s.shard, -1)::int as shard from documents d left join (select doc_id, max(b) as shard from j group by doc_id) s on d.doc_id = s.doc_id
"""
