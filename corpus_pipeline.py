"""The corpus pipeline: what of ``documents`` goes to training, and to which shard.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), with docs what its predecessor kept, and returns what it
keeps. All but the last return the columns they get; the last adds ``shard``. Null and empty texts are rejected by the
first stage. A null id is never a near copy; it has shard -1. A stage's folder goes when the next one has written its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import common, decontaminate, language_id, mixing, ngram_join, sharding


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can't tell go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class that n-gram similarity joins, the document of the least id stays."""
    return ngram_join.drop_near_copies(docs, ngram_join.classes(docs))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token budget, in one epoch at most: no document comes twice."""
    return mixing.mix(docs, max_epochs=1, number_epochs=False)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The network of the first stage can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            common.discard(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
