"""The reference-counted chunk index: first occurrences, recipes, layers, containers, deletion, garbage collection.

``chunks`` everywhere is (doc_id, ordinal, file_offset, size, digest); "seen before" means smaller (doc_id, ordinal).
Payload bytes take part in none of this: only digests, sizes and places are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def occurrences(chunks: DataFrame) -> DataFrame:
    """Each reference with ``nth``, its number among those of its digest, and ``duplicate`` (0 for the first)."""
    nth = F.row_number().over(W.partitionBy("digest").orderBy("doc_id", "ordinal")).cast("bigint")
    return chunks.withColumn("nth", nth).withColumn("duplicate", (F.col("nth") > 1).cast("int"))


def first_of(chunks: DataFrame) -> DataFrame:
    """One row a digest, by partial aggregation: size, references and the first place."""
    return chunks.groupBy("digest").agg(F.first("size").alias("size"), F.count("*").alias("refcount"), F.min(F.struct("doc_id", "ordinal")).alias("place"))


def index(chunks: DataFrame) -> DataFrame:
    return first_of(chunks).select("digest", "size", "refcount", F.col("refcount").alias("frequency"), F.col("place.doc_id").alias("first_doc"), F.col("place.ordinal").alias("first_ordinal"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two indexes as one: counts are added, the earlier index's first places stay."""
    both = old.withColumn("pass", F.lit(0)).unionByName(new.withColumn("pass", F.lit(1)))
    return both.groupBy("digest").agg(F.first("size").alias("size"), F.sum("refcount").alias("refcount"), F.sum("frequency").alias("frequency"), F.min(F.struct("pass", "first_doc", "first_ordinal")).alias("p")).select("digest", "size", "refcount", "frequency", "p.first_doc", "p.first_ordinal")


def layers(chunks: DataFrame, prior: DataFrame | None = None, hot_first: bool = True) -> DataFrame:
    """hot: seen in this pass; cold: in the index before it; miss: neither. With hot_first False every known one is cold.
    The hot layer holds all digests of the pass (see ``layers_lru`` for a bounded one)."""
    seen = occurrences(chunks)
    if prior is not None:
        seen = seen.join(prior.select("digest", F.lit(True).alias("stored")), "digest", "left")
    else:
        seen = seen.withColumn("stored", F.lit(False))
    again = F.when(F.col("nth") > 1, F.lit("hot" if hot_first else "cold"))
    return seen.withColumn("layer", F.coalesce(again, F.when(F.coalesce("stored", F.lit(False)), F.lit("cold")), F.lit("miss"))).drop("stored")


def layers_lru(chunks: DataFrame, prior: DataFrame | None, capacity: int) -> DataFrame:
    """As ``layers`` with a hot layer of the ``capacity`` digests used last. Inherently one ordered pass, over places and digests only;
    it runs in one task, and is meant for reports, not for ingest."""
    from collections import OrderedDict

    stored = prior.select("digest", F.lit(True).alias("stored")) if prior is not None else None
    rows = chunks.select("doc_id", "ordinal", "digest")
    rows = rows.join(stored, "digest", "left") if stored is not None else rows.withColumn("stored", F.lit(None).cast("boolean"))

    def scan(batches):
        hot, known = OrderedDict(), set()
        for pdf in batches:
            out = []
            for digest, was in zip(pdf["digest"], pdf["stored"]):
                if digest in hot:
                    hot.move_to_end(digest)
                    out.append("hot")
                else:
                    out.append("cold" if was is True or digest in known else "miss")
                    hot[digest] = None
                    if len(hot) > capacity:
                        hot.popitem(last=False)
                known.add(digest)
            yield pdf[["doc_id", "ordinal", "digest"]].assign(layer=out)

    return rows.coalesce(1).sortWithinPartitions("doc_id", "ordinal").select("doc_id", "ordinal", "digest", F.coalesce("stored", F.lit(False)).alias("stored")).mapInPandas(scan, "doc_id bigint, ordinal bigint, digest string, layer string")


def containers(chunks: DataFrame, capacity: int = 64 << 20) -> DataFrame:
    """(digest, size, container_id, container_offset) of each digest in the order of first places. A payload goes to the container its
    running offset falls in, so that each is about ``capacity`` bytes; the offset is the one within the container's payloads. The running sum
    is taken in two levels, by ranges of documents, so that no task gets all rows."""
    first = first_of(chunks).select("digest", "size", "place.doc_id", "place.ordinal")
    first = first.withColumn("range", F.floor(F.col("doc_id") / F.lit(4096)))
    before = first.groupBy("range").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "base")
    within = F.sum("size").over(W.partitionBy("range").orderBy("doc_id", "ordinal", "digest").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = first.withColumn("within", within).join(before, "range").withColumn("at", F.col("base") + F.col("within"))
    placed = placed.withColumn("container_id", F.floor(F.col("at") / F.lit(capacity)).cast("bigint") + 1)
    start = F.min("at").over(W.partitionBy("container_id"))
    return placed.select("digest", "size", "container_id", (F.col("at") - start).alias("container_offset"))


def containers_next_fit(chunks: DataFrame, capacity: int = 64 << 20, last: int = 0) -> DataFrame:
    """The same by next fit: a payload that doesn't fit what is left of the present container opens the next one. Each place depends on all before
    it, so this is one ordered pass over sizes (never payloads) in one task; ``containers`` is the form for large stores."""
    first = first_of(chunks).select("digest", "size", "place.doc_id", "place.ordinal")

    def scan(batches):
        container, used = last + 1, 0
        for pdf in batches:
            at, offset = [], []
            for size in pdf["size"]:
                if used > 0 and used + size > capacity:
                    container, used = container + 1, 0
                at.append(container)
                offset.append(used)
                used += size
            yield pdf[["digest", "size"]].assign(container_id=at, container_offset=offset)

    ordered = first.coalesce(1).sortWithinPartitions("doc_id", "ordinal").select("digest", "size")
    return ordered.mapInPandas(scan, "digest string, size bigint, container_id bigint, container_offset bigint")


def recipes(chunks: DataFrame) -> DataFrame:
    return occurrences(chunks).select("doc_id", "ordinal", F.col("digest").alias("chunk_hash"), "file_offset", "size", "duplicate")


def file_summary(chunks: DataFrame) -> DataFrame:
    return occurrences(chunks).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.col("duplicate").cast("bigint")).alias("duplicate_chunks"), F.sum((1 - F.col("duplicate")).cast("bigint")).alias("unique_chunks"), F.sum("size").alias("logical_size"))


def delete(index: DataFrame, chunks: DataFrame, gone: Column) -> DataFrame:
    """The index after the recipes of documents that ``gone`` holds for are deleted: a reference less for each one they had; frequency stays."""
    released = chunks.where(gone).groupBy("digest").agg(F.count("*").alias("released"))
    return index.join(released, "digest", "left").withColumn("refcount", F.col("refcount") - F.coalesce("released", F.lit(0))).drop("released")


def collect_garbage(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row of reclaimed chunks and bytes)."""
    dead = index.where("refcount <= 0")
    return index.where("refcount > 0"), dead.agg(F.count("*").alias("reclaimed_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimed_bytes"))


def totals(chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, unique ones, duplicate references, bytes, sizes and ratio."""
    by = first_of(chunks)
    a = by.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum("refcount"), F.lit(0)).alias("total_refs"))
    b = chunks.agg(F.countDistinct("doc_id").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"), F.round(F.avg("size"), 6).alias("avg_chunk"), F.min("size").alias("min_chunk"), F.max("size").alias("max_chunk"))
    return a.crossJoin(b).withColumn("duplicate_refs", F.greatest(F.col("total_refs") - F.col("unique_chunks"), F.lit(0))).withColumn("dedup_ratio", ratio(F.col("logical_bytes"), F.col("unique_bytes")))


def ratio(logical: Column, stored: Column) -> Column:
    return F.when(stored > 0, F.round(logical / stored, 6)).otherwise(F.lit(1.0))


def index_bytes(unique: Column, duplicates: Column, files: Column, entries: Column) -> Column:
    """Logical bytes of index writes: 240 a new chunk, 184 a duplicate, 128 a file, 96 a recipe entry, 32 for the collection after it."""
    return unique * 240 + duplicates * 184 + files * 128 + entries * 96 + 32
