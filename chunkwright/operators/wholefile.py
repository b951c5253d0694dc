"""Whole-file duplicates by digest, and what the frequency-tiered engine would report for each sighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def digests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, file_hash, file_size); unreadable contents (null) are left out."""
    return files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.md5(content).alias("file_hash"), F.octet_length(content).cast("bigint").alias("file_size"))


def _by_hash():
    return W.partitionBy("file_hash")


def groups(files: DataFrame) -> DataFrame:
    """Files of a content that occurs more than once, with the group's size. Group sizes come by partial aggregation."""
    sizes = files.groupBy("file_hash").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return files.join(sizes, "file_hash").select("file_hash", "path", "file_size", "group_size")


def split(files: DataFrame) -> DataFrame:
    """The first file of a content is unique, later ones (by path) are duplicates."""
    nth = F.row_number().over(_by_hash().orderBy("path"))
    return files.withColumn("status", F.when(nth == 1, "unique").otherwise("duplicate"))


def split_for_chart(files: DataFrame) -> DataFrame:
    """Unique only if the content occurs once; all members of a group are duplicates."""
    sizes = files.groupBy("file_hash").agg(F.count("*").alias("n"))
    return files.join(sizes, "file_hash").select("path", F.when(F.col("n") == 1, "unique").otherwise("duplicate").alias("status"))


def earlier_copies(files: DataFrame) -> DataFrame:
    """For each later copy the earlier paths of the same content, sorted as strings and joined by '; '."""
    before = F.collect_list(F.col("path").cast("string")).over(_by_hash().orderBy("path").rowsBetween(W.unboundedPreceding, -1))
    return files.withColumn("before", before).where(F.size("before") > 0).select("path", "file_hash", F.array_join(F.array_sort("before"), "; ").alias("same_as"), F.size("before").cast("bigint").alias("n_earlier"))


def object_ids(files: DataFrame) -> DataFrame:
    """Dense numbers from 0 by the first sighting of each content. Two levels: counts by range of paths, then numbers within a range."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    first = first.withColumn("range", F.floor(F.col("first_path") / F.lit(4096)))
    base = first.groupBy("range").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "base")
    return first.join(base, "range").select("file_hash", "first_path", (F.col("base") + F.row_number().over(W.partitionBy("range").orderBy("first_path")) - 1).alias("object_id"))


def tier(frequency: Column) -> Column:
    """low: 1 and 2; medium: 3 to 5; high: 6 and more, and 0 (a frequency no tier is made for)."""
    return F.when(frequency.between(1, 2), "low").when(frequency.between(3, 5), "medium").otherwise("high")


def sightings(files: DataFrame) -> DataFrame:
    """What a sighting of a content is to the tiered sketches, without collisions, within one merge period: new four times, then a duplicate,
    as the counted frequency stops at 4."""
    n = F.row_number().over(_by_hash().orderBy("path"))
    before = F.least(n - 1, F.lit(4))
    return files.select("path", "file_hash", n.cast("bigint").alias("sighting"), tier(before).alias("tier"), F.when(n >= 5, "duplicate").otherwise("new").alias("result"), F.when(n >= 5, F.lit(4)).otherwise(n).cast("bigint").alias("frequency"))


def read_only(files: DataFrame, threshold: int = 2) -> DataFrame:
    """The query without side effects after all files are in: duplicate if the counted frequency is over the threshold."""
    counted = F.least(F.count("*"), F.lit(4)).cast("bigint")
    return files.groupBy("file_hash").agg(counted.alias("frequency")).withColumn("result", F.when(F.col("frequency") > threshold, "duplicate").otherwise("new"))


def epochs(files: DataFrame, period: int = 500) -> DataFrame:
    """The merge epoch of each content's first sighting: a merge after every ``period`` new contents."""
    return object_ids(files).select("file_hash", "object_id", F.floor(F.col("object_id") / period).cast("bigint").alias("epoch"))


def merge_periods(start: int, floor: int, merges: int) -> list[int]:
    """The adaptive period's course: from the sixth merge on nine tenths each time, as its efficiency measure is always 0."""
    out = [start]
    for k in range(1, merges):
        out.append(max(floor, int(out[-1] * 0.9)) if k >= 5 else out[-1])
    return out


def prefix_groups(files: DataFrame, groups: int = 20, capacity: int = 1000) -> DataFrame:
    """Contents clustered by the first four hex digits of their digest, each cluster cut into pieces of ``capacity``."""
    prefix = F.substring("file_hash", 1, 4)
    own = files.select("file_hash").distinct().withColumn("prefix", prefix)
    own = own.withColumn("group_id", F.conv("prefix", 16, 10).cast("bigint") % groups)
    piece = F.floor((F.row_number().over(W.partitionBy("group_id").orderBy("file_hash")) - 1) / capacity).cast("bigint")
    return own.withColumn("piece", piece)


def frequency_garbage(files: DataFrame, least: int = 2) -> DataFrame:
    """One row: contents whose true frequency is below ``least``, and references beyond the first of those that stay."""
    counts = files.groupBy("file_hash").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum((F.col("n") < least).cast("bigint")), F.lit(0)).alias("reclaimed"), F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def mb(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)
