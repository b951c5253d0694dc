"""A chunk store in a folder: immutable snapshots and a pointer to the present one.

Layout: STORE (marks a store), v=N/{chunks,files,recipes,payloads,events}, and CURRENT with N in it. An ingest writes a whole new version
beside the old one and then replaces CURRENT by a rename, so readers see the old or the new store, never a mixture, and a lost executor
or driver leaves the old one as it was. Paths are those of a file system all executors share.

chunks (digest, size, refcount, frequency, container_id, container_offset); files (path, logical_size, whole_file_sha256, chunk_count, pass);
recipes (path, ordinal, digest, file_offset, size, pass); payloads (digest, container_id, container_offset, data), appended by version; events.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators import index as X
from chunkwright.operators.chunking import ChunkConfig, chunk

SCHEMAS = {
    "chunks": "digest string, size bigint, refcount bigint, frequency bigint, container_id bigint, container_offset bigint",
    "files": "path string, logical_size bigint, whole_file_sha256 string, chunk_count bigint, pass string",
    "recipes": "path string, ordinal bigint, digest string, file_offset bigint, size bigint, pass string",
    "events": "event string, reclaimed_chunks bigint, reclaimed_bytes bigint",
}
PAYLOADS = "digest string, container_id bigint, container_offset bigint, data binary"


class Store:
    def __init__(self, spark: SparkSession, root: str, cfg: ChunkConfig = ChunkConfig(), container_bytes: int = 64 << 20):
        self.spark, self.root, self.cfg, self.container_bytes = spark, root, cfg, container_bytes
        os.makedirs(root, exist_ok=True)
        mark = os.path.join(root, "STORE")
        if not os.path.exists(mark):
            if os.listdir(root):
                raise ValueError(f"not empty, and not a store: {root}")
            open(mark, "w").close()

    @property
    def version(self) -> int:
        path = os.path.join(self.root, "CURRENT")
        return int(open(path).read()) if os.path.exists(path) else 0

    def _at(self, version: int, name: str) -> str:
        return os.path.join(self.root, f"v={version}", name)

    def table(self, name: str) -> DataFrame:
        path = self._at(self.version, name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if os.path.exists(path) else self.spark.createDataFrame([], SCHEMAS[name])

    def payloads(self) -> DataFrame:
        paths = [p for v in range(1, self.version + 1) if os.path.exists(p := self._at(v, "payloads"))]
        return self.spark.read.schema(PAYLOADS).parquet(*paths) if paths else self.spark.createDataFrame([], PAYLOADS)

    def _publish(self, tables: dict[str, DataFrame]) -> None:
        new = self.version + 1
        shutil.rmtree(os.path.join(self.root, f"v={new}"), ignore_errors=True)  # of an ingest that didn't end
        for name, df in tables.items():
            if name == "chunks":
                df = df.repartitionByRange("digest").sortWithinPartitions("digest")  # so that lookups prune row groups
            df.write.parquet(self._at(new, name))
        part = os.path.join(self.root, "CURRENT.new")
        with open(part, "w") as f:
            f.write(str(new))
        os.replace(part, os.path.join(self.root, "CURRENT"))

    def ingest(self, files: DataFrame, label: str = "", once: bool = True) -> None:
        """files: (path, content). With ``once``, files that this label already has with the same content aren't counted again."""
        files = files.where("content is not null").select("path", "content").withColumn("whole_file_sha256", F.sha2("content", 256))
        if once:
            files = files.join(self.table("files").where(F.col("pass") == label).select("path", "whole_file_sha256"), ["path", "whole_file_sha256"], "left_anti")
        new = self.version + 1
        pieces = chunk(files, "path", "content", self.cfg, with_data=True)
        staged = os.path.join(self.root, f"staged-{new}")
        shutil.rmtree(staged, ignore_errors=True)
        pieces.write.parquet(staged)
        pieces = self.spark.read.parquet(staged)
        refs = pieces.drop("data")
        old = self.table("chunks")
        counts = refs.groupBy("digest").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.min(F.struct("path", "ordinal")).alias("place"))
        fresh = counts.join(old.select("digest"), "digest", "left_anti")
        last = old.agg(F.coalesce(F.max("container_id"), F.lit(0)).alias("last"))
        numbered = fresh.select(F.pmod(F.xxhash64("place.path"), F.lit(1 << 22)).alias("doc_id"), F.col("place.ordinal").alias("ordinal"), "digest", "size")
        places = X.containers(numbered, self.container_bytes).crossJoin(last).select("digest", (F.col("container_id") + F.col("last")).alias("container_id"), "container_offset")
        added = counts.join(places, "digest").select("digest", "size", F.col("n").alias("refcount"), F.col("n").alias("frequency"), "container_id", "container_offset")
        kept = old.join(counts.select("digest", "n"), "digest", "left").select("digest", "size", (F.col("refcount") + F.coalesce("n", F.lit(0))).alias("refcount"), (F.col("frequency") + F.coalesce("n", F.lit(0))).alias("frequency"), "container_id", "container_offset")
        data = pieces.join(places, "digest").dropDuplicates(["digest"]).select("digest", "container_id", "container_offset", "data")
        sizes = refs.groupBy("path").agg(F.count("*").alias("chunk_count"))
        catalogue = files.select("path", F.octet_length("content").cast("bigint").alias("logical_size"), "whole_file_sha256").join(sizes, "path", "left").select("path", "logical_size", "whole_file_sha256", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(label).alias("pass"))
        self._publish({
            "payloads": data,
            "chunks": kept.unionByName(added),
            "files": self.table("files").unionByName(catalogue),
            "recipes": self.table("recipes").unionByName(refs.withColumn("pass", F.lit(label)).select("path", "ordinal", "digest", "file_offset", "size", "pass")),
            "events": self.table("events"),
        })
        shutil.rmtree(staged, ignore_errors=True)

    def lookup(self, digest: str) -> DataFrame:
        return self.table("chunks").where(F.col("digest") == digest)

    def delete(self, gone: Column) -> None:
        """Recipes of the files that ``gone`` (over path, pass) holds for; their references are released, payloads stay until ``collect``."""
        files, recipes = self.table("files"), self.table("recipes")
        released = recipes.where(gone).groupBy("digest").agg(F.count("*").alias("n"))
        chunks = self.table("chunks").join(released, "digest", "left").withColumn("refcount", F.col("refcount") - F.coalesce("n", F.lit(0))).drop("n")
        self._publish({"chunks": chunks, "files": files.where(~gone), "recipes": recipes.where(~gone), "events": self.table("events")})

    def collect(self) -> tuple[int, int]:
        """Chunks without references leave the index; (chunks, bytes) reclaimed."""
        kept, dead = X.collect_garbage(self.table("chunks"))
        row = dead.first()
        event = self.spark.createDataFrame([("gc", row[0], row[1])], SCHEMAS["events"])
        self._publish({"chunks": kept, "files": self.table("files"), "recipes": self.table("recipes"), "events": self.table("events").unionByName(event)})
        return row[0], row[1]

    def restore(self) -> DataFrame:
        """(path, pass, content) of every file, from its recipe and the payloads."""
        parts = self.table("recipes").join(self.payloads().select("digest", "data"), "digest")
        parts = parts.groupBy("path", "pass").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("p"))
        parts = parts.select("path", "pass", F.aggregate(F.transform("p", lambda x: x["data"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))
        return self.table("files").select("path", "pass").join(parts, ["path", "pass"], "left").select("path", "pass", F.coalesce("content", F.lit(b"")).alias("content"))

    def audit(self) -> DataFrame:
        """Payloads whose digest isn't theirs; must be empty."""
        return self.payloads().where(F.sha2("data", 256) != F.col("digest"))

    def physical_bytes(self) -> int:
        """Of the present version's index files, after they were written."""
        return sum(os.path.getsize(os.path.join(d, f)) for n in ("chunks", "files", "recipes") for d, _, fs in os.walk(self._at(self.version, n)) for f in fs if f.endswith(".parquet"))

    def statistics(self, label: str = "") -> DataFrame:
        chunks, files, recipes = self.table("chunks"), self.table("files"), self.table("recipes")
        c = chunks.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum("refcount"), F.lit(0)).alias("total_refs"))
        f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("logical_size"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.when(F.col("pass") == label, F.col("logical_size"))), F.lit(0)).alias("session_bytes"))
        r = recipes.agg(F.round(F.avg("size"), 6).alias("avg_chunk"), F.min("size").alias("min_chunk"), F.max("size").alias("max_chunk"))
        row = c.crossJoin(f).crossJoin(r).withColumn("chunks", F.col("total_refs")).withColumn("duplicate_refs", F.greatest(F.col("total_refs") - F.col("unique_chunks"), F.lit(0)))
        row = row.withColumn("dedup_ratio", X.ratio(F.col("logical_bytes"), F.col("unique_bytes"))).withColumn("session_over_stored", X.ratio(F.col("session_bytes"), F.col("unique_bytes")))
        logical = X.index_bytes(F.col("unique_chunks"), F.col("duplicate_refs"), F.col("files"), F.col("total_refs"))
        return row.withColumn("index_bytes", logical).withColumn("write_amplification", F.round(F.lit(self.physical_bytes()) / F.col("index_bytes"), 6)).withColumn("run_label", F.lit(label))


def reset(root: str) -> None:
    """Remove a store; anything that isn't one is refused."""
    if os.path.exists(root):
        if not os.path.exists(os.path.join(root, "STORE")):
            raise ValueError(f"not a store: {root}")
        shutil.rmtree(root)
