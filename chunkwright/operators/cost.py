"""Hit probabilities, expected costs, and the means and percentiles of measured costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Nanoseconds assumed before anything was measured.
DEFAULT_COSTS = {"hot_lookup": 5_000, "cold_lookup": 200_000, "verify": 50_000, "cold_write": 500_000}


def beta_mean(hits: Column, queries: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """The posterior mean of a hit rate."""
    return (F.lit(alpha) + hits) / (F.lit(alpha + beta) + queries)


def floored_confidence(hits: Column, queries: Column) -> Column:
    """Prior Beta(5, 2), at least 0.2 once there was a query."""
    p = beta_mean(hits, queries, 5.0, 2.0)
    return F.when(queries > 0, F.greatest(p, F.lit(0.2))).otherwise(p)


def risks(c_hot: Column, p_hot: Column, c_cold: Column, p_cold: Column) -> tuple[Column, Column]:
    """Expected cost of looking into the hot layer first, and into the cold one first."""
    return c_hot + (1 - p_hot) * c_cold, c_cold + (1 - p_cold) * c_hot


def choose_strategy(c_hot: float, p_hot: float, c_cold: float, p_cold: float) -> str:
    return "hot_first" if c_hot + (1 - p_hot) * c_cold <= c_cold + (1 - p_cold) * c_hot else "cold_first"


def moving_mean(rows: DataFrame, order: str, value: str, partition: str, last: int = 1000, least: float = 1.0) -> DataFrame:
    """The mean of the last ``last`` values so far within each partition, each at least ``least``. Summed in millionths, so the order of
    additions doesn't matter."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("moving_mean", F.sum(F.round(F.greatest(F.col(value), F.lit(least)) * 1e6).cast("bigint")).over(w) / F.lit(1e6) / F.count("*").over(w))


def rank_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...], by: list[str]) -> DataFrame:
    """The sorted values' element number min(int(p n), n - 1), from 0: not percentile_disc."""
    n = F.size("v")
    pick = [F.element_at("v", F.least(F.floor(F.lit(p) * n).cast("int"), n - 1) + 1).alias(f"p{round(p * 100)}") for p in shares]
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*by, *pick)


def percentiles_by_rank(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The same over all rows, without gathering them: equal values are counted, and running counts of the distinct values in
    ranges find the element."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n")).where(F.col(value).isNotNull())
    edges = counts.withColumn("range", F.floor(F.log2(F.greatest(F.abs(F.col(value)), F.lit(1e-300)))) * F.when(F.col(value) < 0, -1).otherwise(1) + F.when(F.col(value) < 0, -2000).otherwise(2000))
    base = edges.groupBy("range").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "base")
    upto = edges.join(base, "range").withColumn("upto", F.col("base") + F.sum("n").over(W.partitionBy("range").orderBy(value)))
    whole = counts.agg(F.sum("n").alias("whole"))
    target = lambda p: F.least(F.floor(F.lit(p) * F.col("whole")), F.col("whole") - 1) + 1
    return upto.crossJoin(whole).agg(*(F.min(F.when(F.col("upto") >= target(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares))
