"""Histograms, descriptions, rolling means and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkwright.functions.hashing import format_bytes


def histogram(rows: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, n) of ``bins`` equal widths between the least and largest value, or their decimal logarithms; the largest is in the last bin."""
    v = F.log10(F.col(value)) if log else F.col(value).cast("double")
    own = rows.select(v.alias("v"))
    edges = own.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return own.crossJoin(edges).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max of each column, one row each, rounded to 2 digits."""
    parts = []
    for c in columns:
        q = [F.round(F.percentile(c, p), 2).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
        parts.append(rows.agg(F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), 2).alias("mean"), F.round(F.stddev_samp(c), 2).alias("std"), F.min(c).cast("double").alias("min"), *q, F.max(c).cast("double").alias("max")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centred_mean(rows: DataFrame, order: str, value: str, partition: str, window: int = 50) -> DataFrame:
    """The mean of half a window before to half a window after; null where it is not complete."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(-(window // 2), window - window // 2 - 1)
    return rows.withColumn("centred_mean", F.when(F.count("*").over(w) == window, F.avg(value).over(w)))


def cumulative(rows: DataFrame, order: str, value: str, partition: str) -> DataFrame:
    """Running sums, and rows a unit of them."""
    w = W.partitionBy(partition).orderBy(order)
    rows = rows.withColumn("file_index", F.row_number().over(w).cast("bigint")).withColumn("cumulative", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("speed", F.when(F.col("cumulative") != 0, F.col("file_index") / F.col("cumulative")))


#: Metrics of a run in the order of a report, and how each is written.
METRICS = [("run_label", "str"), ("files", "int"), ("chunks", "int"), ("unique_chunks", "int"), ("duplicate_refs", "int"), ("logical_bytes", "bytes"), ("unique_bytes", "bytes"), ("avg_chunk", "float0"), ("min_chunk", "int"), ("max_chunk", "int"), ("dedup_ratio", "float4"), ("share_duplicate", "pct")]


def long_form(run: DataFrame, label: str) -> DataFrame:
    """(metric, hint, text, value) of a one-row DataFrame."""
    numbers = [(m, h) for m, h in METRICS if h != "str"]
    stack = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(h).alias("hint"), F.col(m).cast("double").alias(label)) for m, h in numbers))
    return run.select(F.explode(stack).alias("x")).select("x.*")


def shown(value: Column, hint: Column) -> Column:
    out = F.format_string("%.4f", value)
    out = F.when(hint == "int", F.format_string("%d", value.cast("bigint"))).when(hint == "bytes", format_bytes(value)).when(hint == "float0", F.format_string("%.0f", value)).when(hint == "pct", F.format_string("%.2f%%", value * 100)).otherwise(out)
    return F.when(value.isNull(), "—").otherwise(out)


def delta(a: Column, b: Column, hint: Column) -> Column:
    d = b - a
    sign = F.when(d > 0, "+").when(d < 0, "-").otherwise("")
    size = F.abs(d)
    text = F.when(hint == "pct", F.format_string("%.2f pp", size * 100)).otherwise(shown(size, hint))
    return F.when(d.isNull(), "—").otherwise(F.concat(sign, text))


def run_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(metric, first, second, delta) of the metrics that either run has."""
    both = long_form(first, "a").join(long_form(second, "b"), ["metric", "hint"], "full").where("a is not null or b is not null")
    a, b, h = F.col("a"), F.col("b"), F.col("hint")
    return both.select("metric", shown(a, h).alias("first"), shown(b, h).alias("second"), delta(a, b, h).alias("delta"))
