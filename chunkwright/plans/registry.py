"""The queries of the storage engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwright.plans import analysis_queries, sketch_queries, storage_queries, text_queries, wholefile_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (storage_queries, wholefile_queries, sketch_queries, text_queries, analysis_queries):
    QUERIES |= module.R.queries
    ORACLES |= module.R.oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["storage_by_source"](spark, sf_dir)
