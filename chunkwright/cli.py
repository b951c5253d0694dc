"""Commands: ingest, duplicates, compare, prepare, mutate, benchmark."""

from __future__ import annotations

import argparse
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators import analysis, store, textprep, wholefile
from chunkwright.operators import index as X
from chunkwright.operators.chunking import ChunkConfig, chunk
from chunkwright.sources import files as S


def ingest(spark: SparkSession, root: str, where: str, out: str, cfg: ChunkConfig, label: str = "run", fresh: bool = False, hidden: bool = False) -> DataFrame:
    if fresh:
        store.reset(where)
    s = store.Store(spark, where, cfg)
    s.ingest(S.read_files(spark, root, hidden), label)
    s.collect()
    os.makedirs(out, exist_ok=True)
    chunks = s.table("chunks")
    S.write_csv(chunks.where("refcount > 1").orderBy(F.desc("refcount"), F.desc("size"), "digest"), f"{out}/duplicate_chunks")
    S.write_csv(chunks.orderBy("digest"), f"{out}/unique_chunks")
    S.write_csv(s.table("recipes").orderBy("path", "ordinal"), f"{out}/file_recipes")
    S.write_csv(s.table("files").orderBy("path"), f"{out}/file_summary")
    row = s.statistics(label)
    S.write_statistics(row, f"{out}/statistics.json")
    return row


def duplicates(spark: SparkSession, root: str, out: str, hidden: bool = False) -> DataFrame:
    found = wholefile.digests(S.read_files(spark, os.path.abspath(root), hidden))
    S.write_csv(wholefile.earlier_copies(found), f"{out}/duplicate_files")
    S.write_csv(wholefile.split(found).where("status = 'unique'"), f"{out}/unique_files")
    S.write_csv(wholefile.groups(found), f"{out}/duplicate_groups")
    return wholefile.split(found).groupBy("status").agg(F.count("*").alias("files"))


def compare(spark: SparkSession, first: str, second: str) -> DataFrame:
    rows = []
    for path in (first, second):
        row = S.read_statistics(spark, path)
        for name, _ in analysis.METRICS:
            if name not in row.columns:
                row = row.withColumn(name, F.lit(None).cast("double"))
        rows.append(row)
    return analysis.run_diff(*rows)


def prepare(spark: SparkSession, dump: str, out: str, least: int = 500, limit: int | None = None) -> None:
    S.write_articles(S.clean_articles(S.read_dump(spark, dump), least, limit), out)


def mutate(spark: SparkSession, root: str, out: str, fraction: float = textprep.FRACTION) -> None:
    """A second version of a folder of texts, as (path, text) in Parquet."""
    texts = S.read_files(spark, root).select("path", F.decode("content", "UTF-8").alias("text"))
    new = F.when(textprep.chosen(F.col("path"), fraction), textprep.mutate_lines(F.col("text"), F.col("path"))).otherwise(F.col("text"))
    texts.withColumn("text", new).write.mode("overwrite").parquet(out)


def benchmark(spark: SparkSession, root: str, cfg: ChunkConfig, trials: int = 5) -> DataFrame:
    """Seconds of each method over the same chunks, kept once: mean and sample deviation."""
    records = chunk(S.read_files(spark, root), "path", "content", cfg).select("path", "ordinal", "digest", "size").persist()
    records.count()
    methods = {
        "exact_index": lambda: records.groupBy("digest").agg(F.count("*").alias("n"), F.first("size").alias("size")),
        "first_occurrence": lambda: X.occurrences(records.withColumnRenamed("path", "doc_id")).where("duplicate = 1"),
        "prefix_partitioned": lambda: records.repartition(F.substring("digest", 1, 2)).dropDuplicates(["digest"]),
    }
    rows = []
    for name, method in methods.items():
        took = []
        for _ in range(trials):
            began = time.perf_counter()
            method().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        rows.append((name, trials, statistics.mean(took), statistics.stdev(took) if trials > 1 else 0.0))
    records.unpersist()
    return spark.createDataFrame(rows, "method string, trials int, mean_s double, std_s double")


def pipeline(spark: SparkSession, v1: str, v2: str, where: str, out: str, cfg: ChunkConfig) -> DataFrame:
    """Two passes against one store and their comparison. A pass whose output exists isn't run again, and no pass counts twice."""
    for label, root in (("pass1", v1), ("pass2", v2)):
        if not os.path.exists(f"{out}/{label}/statistics.json"):
            ingest(spark, root, where, f"{out}/{label}", cfg, label)
    return compare(spark, f"{out}/pass1/statistics.json", f"{out}/pass2/statistics.json")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chunkwright")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        return c

    for c in (add("ingest", "root"), add("benchmark", "root")):
        for option, value in (("--min-size", 2048), ("--avg-size", 8192), ("--max-size", 65536)):
            c.add_argument(option, type=int, default=value)
        if c.prog.endswith("ingest"):
            c.add_argument("--store", required=True)
            c.add_argument("--out", required=True)
            c.add_argument("--label", default="run")
            c.add_argument("--reset", action="store_true")
            c.add_argument("--include-hidden", action="store_true")
        else:
            c.add_argument("--trials", type=int, default=5)
    c = add("duplicates", "root")
    c.add_argument("--out", required=True)
    c.add_argument("--include-hidden", action="store_true")
    add("compare", "first", "second")
    c = add("prepare", "dump", "out")
    c.add_argument("--min-chars", type=int, default=500)
    c.add_argument("--limit", type=int)
    c = add("mutate", "root", "out")
    c.add_argument("--fraction", type=float, default=textprep.FRACTION)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("ingest", "benchmark"):
        cfg = ChunkConfig(a.min_size, a.avg_size, a.max_size)
        (ingest(spark, a.root, a.store, a.out, cfg, a.label, a.reset, a.include_hidden) if a.command == "ingest" else benchmark(spark, a.root, cfg, a.trials)).show(truncate=False)
    elif a.command == "duplicates":
        duplicates(spark, a.root, a.out, a.include_hidden).show()
    elif a.command == "compare":
        compare(spark, a.first, a.second).show(100, truncate=False)
    elif a.command == "prepare":
        prepare(spark, a.dump, a.out, a.min_chars, a.limit)
    else:
        mutate(spark, a.root, a.out, a.fraction)


if __name__ == "__main__":
    main()
