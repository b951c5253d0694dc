"""Whole documents as files: the path is doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.operators import wholefile as X
from chunkwright.plans.register import Register
from chunkwright.tables import table

R = Register()
H = "with f as (select doc_id as path, md5(text) as file_hash, octet_length(encode(text)) as file_size from documents where text is not null)"


def files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return X.digests(docs)


@R("whole_file_groups", H + ", g as (select *, count(*) over (partition by file_hash) as group_size from f) select * from g where group_size > 1")
def whole_file_groups(spark, sf_dir):
    return X.groups(files(spark, sf_dir))


@R("whole_file_split", H + " select path, file_hash, file_size, case when row_number() over (partition by file_hash order by path) = 1 then 'unique' else 'duplicate' end as status from f")
def whole_file_split(spark, sf_dir):
    return X.split(files(spark, sf_dir))


@R("whole_file_split_chart", H + " select path, case when count(*) over (partition by file_hash) = 1 then 'unique' else 'duplicate' end as status from f")
def whole_file_split_chart(spark, sf_dir):
    return X.split_for_chart(files(spark, sf_dir))


@R("same_hash_lists", H + " select a.path, a.file_hash, string_agg(b.path::varchar, '; ' order by b.path::varchar) as same_as, count(*) as n_earlier from f a join f b on a.file_hash = b.file_hash and b.path < a.path group by 1, 2")
def same_hash_lists(spark, sf_dir):
    return X.earlier_copies(files(spark, sf_dir))


@R("object_ids", H + ", m as (select file_hash, min(path) as first_path from f group by 1) select *, row_number() over (order by first_path) - 1 as object_id from m")
def object_ids(spark, sf_dir):
    return X.object_ids(files(spark, sf_dir))


@R("merge_epochs", H + ", m as (select file_hash, row_number() over (order by min(path)) - 1 as object_id from f group by 1) select *, object_id // 500 as epoch from m")
def merge_epochs(spark, sf_dir):
    return X.epochs(files(spark, sf_dir))


@R("legacy_tier_labels", H + """, n as (select path, file_hash, row_number() over (partition by file_hash order by path) as sighting from f)
select path, file_hash, sighting, case when least(sighting - 1, 4) between 1 and 2 then 'low' when least(sighting - 1, 4) between 3 and 5 then 'medium' else 'high' end as tier, case when sighting >= 5 then 'duplicate' else 'new' end as result, least(sighting, 4) as frequency from n""")
def legacy_tier_labels(spark, sf_dir):
    return X.sightings(files(spark, sf_dir))


@R("legacy_query", H + " select file_hash, least(count(*), 4) as frequency, case when least(count(*), 4) > 2 then 'duplicate' else 'new' end as result from f group by 1")
def legacy_query(spark, sf_dir):
    return X.read_only(files(spark, sf_dir))


@R("hot_promotion", H + " select file_hash, count(*) as frequency from f group by 1 having count(*) > 5")
def hot_promotion(spark, sf_dir):
    return files(spark, sf_dir).groupBy("file_hash").agg(F.count("*").alias("frequency")).where("frequency > 5")


@R("prefix_groups", H + ", d as (select distinct file_hash, substr(file_hash, 1, 4) as prefix from f), g as (select *, ('0x' || prefix)::bigint % 20 as group_id from d) select *, (row_number() over (partition by group_id order by file_hash) - 1) // 1000 as piece from g")
def prefix_groups(spark, sf_dir):
    return X.prefix_groups(files(spark, sf_dir))


@R("group_objects", H + ", d as (select distinct file_hash from f) select file_hash from d where ('0x' || substr(file_hash, 1, 4))::bigint % 20 = 7")
def group_objects(spark, sf_dir):
    return X.prefix_groups(files(spark, sf_dir)).where("group_id = 7").select("file_hash")


@R("duplicates_across_groups", H + " select a.path as path_a, b.path as path_b, a.file_hash from f a join f b on a.file_hash = b.file_hash and a.path < b.path")
def duplicates_across_groups(spark, sf_dir):
    f = files(spark, sf_dir)
    a, b = f.select("file_hash", F.col("path").alias("path_a")), f.select("file_hash", F.col("path").alias("path_b"))
    return a.join(b, "file_hash").where("path_a < path_b").select("path_a", "path_b", "file_hash")


@R("gc_frequency", H + ", c as (select file_hash, count(*) as n from f group by 1) select count(*) filter (n < 2) as reclaimed, coalesce(sum(n - 1) filter (n >= 2), 0)::bigint as duplicates from c")
def gc_frequency(spark, sf_dir):
    return X.frequency_garbage(files(spark, sf_dir))


@R("duplicate_files_table", H + ", n as (select *, row_number() over (partition by file_hash order by path) as k, min(path) over (partition by file_hash) as original, count(*) over (partition by file_hash) as group_size from f) select path, original, file_hash, file_size, round(file_size / 1048576.0::double, 2) as size_mb, group_size - 1 as duplicate_count, 'hash_match' as detection_layer from n where k > 1")
def duplicate_files_table(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("file_hash")
    f = files(spark, sf_dir).withColumns({"k": F.row_number().over(by.orderBy("path")), "original": F.min("path").over(by), "group_size": F.count("*").over(by)})
    return f.where("k > 1").select("path", "original", "file_hash", "file_size", X.mb(F.col("file_size")).alias("size_mb"), (F.col("group_size") - 1).alias("duplicate_count"), F.lit("hash_match").alias("detection_layer"))


@R("unique_files_table", H + ", n as (select *, row_number() over (partition by file_hash order by path) as k from f) select path, file_hash, file_size, round(file_size / 1048576.0::double, 2) as size_mb from n where k = 1")
def unique_files_table(spark, sf_dir):
    return X.split(files(spark, sf_dir)).where("status = 'unique'").select("path", "file_hash", "file_size", X.mb(F.col("file_size")).alias("size_mb"))


@R("trie_dedup", H + " select count(distinct file_hash) as unique_count, count(*) - count(distinct file_hash) as duplicate_count from f")
def trie_dedup(spark, sf_dir):
    return files(spark, sf_dir).groupBy("file_hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_count"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicate_count"))


@R("pairwise_dedup", H + " select count(*) filter (not exists (select 1 from f b where b.file_hash = a.file_hash and b.path < a.path)) as unique_count, count(*) filter (exists (select 1 from f b where b.file_hash = a.file_hash and b.path < a.path)) as duplicate_count from f a")
def pairwise_dedup(spark, sf_dir):
    """The pairwise form of the same result: a file is a duplicate if an earlier one has its digest (an equi-join, not all pairs)."""
    f = files(spark, sf_dir)
    earlier = f.select("file_hash", F.col("path").alias("p")).groupBy("file_hash").agg(F.min("p").alias("p"))
    return f.join(earlier, "file_hash").agg(F.sum((F.col("p") == F.col("path")).cast("bigint")).alias("unique_count"), F.sum((F.col("p") < F.col("path")).cast("bigint")).alias("duplicate_count"))


@R("fixed_sample", H + ", s as (select path, file_hash, md5('1234:' || path::varchar) as k from f) select path, file_hash from s order by k, path limit 500")
def fixed_sample(spark, sf_dir):
    """500 files drawn by a seeded hash, always the same."""
    return files(spark, sf_dir).withColumn("k", F.md5(F.concat(F.lit("1234:"), F.col("path").cast("string")))).orderBy("k", "path").limit(500).select("path", "file_hash")
