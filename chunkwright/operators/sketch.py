"""Bloom filters and Count-Min sketches as relations: a filter is its set positions, a sketch its cells.

Building and merging are aggregations with map-side combining; probing is a join by position. Seeds are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.hashing import md5_mod
from chunkwright.operators.wholefile import tier

HASHES, HOT_SIZE, COLD_SIZE = 4, 200_003, 1_000_003
DEPTH, HOT_WIDTH, COLD_WIDTH = 4, 100_003, 200_003


def positions(rows: DataFrame, key: str, size: int = HOT_SIZE, first_seed: int = 0) -> DataFrame:
    """Every row with its HASHES positions, one row each."""
    at = F.array(*(md5_mod(first_seed + k, F.col(key).cast("string"), size) for k in range(HASHES)))
    return rows.withColumn("position", F.explode(F.array_distinct(at)))


def bloom(rows: DataFrame, key: str, size: int = HOT_SIZE, first_seed: int = 0) -> DataFrame:
    return positions(rows.select(key), key, size, first_seed).select("position").distinct()


def probe(rows: DataFrame, key: str, filter_: DataFrame, size: int = HOT_SIZE, first_seed: int = 0) -> DataFrame:
    """(key, maybe): whether all of a key's positions are set."""
    asked = positions(rows.select(key).distinct(), key, size, first_seed)
    return asked.join(filter_.select("position", F.lit(1).alias("set")), "position", "left").groupBy(key).agg((F.count("set") == F.count("*")).alias("maybe"))


def cells(rows: DataFrame, key: str, width: int = HOT_WIDTH, first_seed: int = 1000) -> DataFrame:
    """(row, col, count)."""
    at = F.array(*(F.struct(F.lit(k).alias("row"), md5_mod(first_seed + k, F.col(key).cast("string"), width).alias("col")) for k in range(DEPTH)))
    return rows.select(F.explode(at).alias("x")).groupBy("x.row", "x.col").agg(F.count("*").alias("count"))


def merge_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("count").alias("count"))


def estimate(rows: DataFrame, key: str, sketch: DataFrame, width: int = HOT_WIDTH, first_seed: int = 1000) -> DataFrame:
    """(key, estimate): the least of a key's cells; 0 where one was never touched."""
    at = F.array(*(F.struct(F.lit(k).alias("row"), md5_mod(first_seed + k, F.col(key).cast("string"), width).alias("col")) for k in range(DEPTH)))
    asked = rows.select(key).distinct().select(key, F.explode(at).alias("x")).select(key, "x.row", "x.col")
    return asked.join(sketch, ["row", "col"], "left").groupBy(key).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


TIER_SIZES = {"low": 1, "medium": 2, "high": 4}


def tiered(counts: DataFrame, key: str, frequency: str, size: int = HOT_SIZE) -> DataFrame:
    """(tier, position): keys in the filter of their frequency's tier, larger for higher tiers."""
    width = F.lit(size)
    name = tier(F.col(frequency))
    for t, k in TIER_SIZES.items():
        width = F.when(F.col("tier") == t, F.lit(size * k)).otherwise(width)

    def at(k: int) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(F.lit(str(k)), F.col(key).cast("string"), F.col("tier"))), 1, 15), 16, 10).cast("bigint")
        return digits % width

    return counts.withColumn("tier", name).withColumn("position", F.explode(F.array(*(at(k) for k in range(3))))).select("tier", "position").distinct()
