"""Corpora in directories, XML dumps, statistics and tables in files; and what is written back."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.operators import textprep

LISTING = "path string, length bigint"


def walk(root: str, include_hidden: bool = False) -> Iterator[tuple[str, int]]:
    """(path, length) of the regular files below root. Names that begin with a dot are left out (folders with all below them) unless
    asked for; links to files count, links to folders are not followed."""
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if include_hidden or not n.startswith("."))
        for name in sorted(files):
            path = os.path.join(folder, name)
            if (include_hidden or not name.startswith(".")) and os.path.isfile(path):
                yield path, os.path.getsize(path)


def list_files(spark: SparkSession, root: str, include_hidden: bool = False, strict: bool = False) -> DataFrame:
    """The listing, by names and sizes only. With strict a root that is not a folder is an error."""
    if strict and not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    base = os.path.abspath(root) if strict else root
    return spark.createDataFrame(list(walk(base, include_hidden)), LISTING)


def scanned_folders(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct(F.regexp_replace("path", r"/[^/]*$", "")).alias("folders"))


def read_files(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """(path, length, content), contents read by the tasks. Spark's own binary source leaves out files whose name begins with "_" and empty
    ones, so the listing decides; a file that can't be read has a null content. A content is one value: 2 GB at most."""
    files = list_files(spark, root, include_hidden)

    def load(batches):
        for pdf in batches:
            contents = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield pdf.assign(content=contents)

    parts = max(1, min(files.count() // 64 + 1, 10_000))
    return files.repartition(parts, "path").mapInPandas(load, LISTING + ", content binary")


PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.StringType()),
    T.StructField("revision", T.StructType([T.StructField("text", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType())])))])),
])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, text) of the articles of an XML dump, plain or .bz2: those of namespace 0 with a title and a text that aren't redirects."""
    pages = spark.read.format("xml").option("rowTag", "page").option("nullValue", "").schema(PAGE).load(path)
    text = F.array_join(F.transform("revision.text", lambda t: F.coalesce(t["_VALUE"], F.lit(""))), "")
    pages = pages.select(F.trim("title").alias("title"), F.coalesce(F.expr("try_cast(ns as int)"), F.lit(-1)).alias("ns"), F.coalesce(text, F.lit("")).alias("text"))
    return pages.where(textprep.is_article(F.coalesce("title", F.lit("")), F.col("ns"), F.col("text")))


def clean_articles(pages: DataFrame, least: int = 500, limit: int | None = None) -> DataFrame:
    """Templates and markup removed, short ones dropped; ``limit`` counts what is kept, by title."""
    text = textprep.strip_markup(textprep.remove_templates(F.col("text")))
    out = pages.withColumn("text", F.explode(F.filter(F.array(text), lambda x: F.length(x) >= least)))  # a filter on the column would evaluate it again
    return out.orderBy("title").limit(limit) if limit is not None else out


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of a run; its label is ``run_label``, or the file's name."""
    row = spark.read.json(path, multiLine=True)
    name = os.path.splitext(os.path.basename(path))[0]
    return row if "run_label" in row.columns else row.withColumn("run_label", F.lit(name))


def read_csv(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table in CSV; no file, no rows."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header, also if there are no rows. single is for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_statistics(df: DataFrame, path: str) -> None:
    """One row as JSON, keys sorted."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(df.first().asDict(), f, indent=2, sort_keys=True, default=str)


def write_articles(pages: DataFrame, path: str, per_folder: int = 10_000) -> None:
    """title, blank line, text and a line end, in folders by number of article; the text source's rows are whole articles."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.orderBy("title")) - 1  # titles only
    places = pages.select("title").distinct().withColumn("number", number)
    body = F.concat("title", F.lit("\n\n"), "text")
    out = pages.join(places, "title").select(F.lpad(F.floor(F.col("number") / per_folder).cast("string"), 2, "0").alias("shard"), body.alias("value"))
    out.write.mode("overwrite").partitionBy("shard").text(path)
