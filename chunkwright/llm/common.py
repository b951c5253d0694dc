"""Helpers that the corpus operators share: the shared folder, Arrow batches, reduction of fixed-size arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time (a longer text is taken whole).
PASS_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, one of this machine's on a local master, as in tests; elsewhere an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="chunkwright-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is written there goes at the latest when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = _path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of which no living table reads any more."""
    system, path = _path(spark, folder)
    system.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with no lineage left: a lost executor costs nothing that was done."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of the column, at least one row each."""
    if batch.num_rows == 0:
        return
    size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


SLICE = 65_536


def pack_slices(values: np.ndarray) -> pa.RecordBatch:
    """A large array as rows (slice, data) of compressed pieces of SLICE values; pieces of zeros are left out."""
    at, data = [], []
    for k in range(0, len(values), SLICE):
        piece = values[k : k + SLICE]
        if piece.any():
            at.append(k // SLICE)
            data.append(pa.compress(piece.tobytes(), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["slice", "data"])


def sum_slices(rows: DataFrame, dtype: str, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One row a slice. The number of slices and their size are fixed, so what reaches one task grows only with the number of map tasks."""
    width = np.dtype(dtype).itemsize

    def reduce(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, dtype)
        for blob in table.column("data"):
            raw = blob.as_py()
            size = SLICE * width
            piece = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), dtype)
            total = combine(total, piece)
        return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    return rows.groupBy("slice").applyInArrow(reduce, "slice int, data binary")


def gather_slices(rows: DataFrame, length: int, dtype: str) -> np.ndarray:
    """The array on the driver; its size is a parameter and doesn't grow with the corpus."""
    out = np.zeros(length, dtype)
    width = np.dtype(dtype).itemsize
    for r in rows.collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(pa.decompress(bytes(r["data"]), decompressed_size=SLICE * width, codec="zstd", asbytes=True), dtype)
    return out


#: Bits that a key gets in ``Marks``, the least bits of all, and the most (16 MB).
PER_KEY, LEAST_BITS, MOST_BITS = 8, 19, 27


def _cell(ids: np.ndarray, bits: int) -> np.ndarray:
    from chunkwright.llm.textscan import mix

    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


class Marks:
    """Bits that mark the hashes of a bigint column without nulls, sent to the executors. Their use is to leave rows out of a shuffle before an exact join: a miss is
    certain, a hit is decided by the join. The bits follow the number of rows, PER_KEY for each, up to 2**MOST_BITS, so that what is sent is at most 16 MB; with more
    keys than that (16 million at 8 bits each), more rows go through the join, at the end all of them. rows is read twice: give a table that was cut."""

    def __init__(self, rows: DataFrame, name: str):
        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, (PER_KEY * max(1, rows.count()) - 1).bit_length()))

        def scan(batches):
            marks = np.zeros(1 << bits >> 3, np.uint8)
            for batch in batches:
                at = np.unique(_cell(column(batch, name).to_numpy(zero_copy_only=False), bits))
                np.bitwise_or.at(marks, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            if marks.any():
                yield pack_slices(marks)

        packed = rows.select(name).mapInArrow(scan, "slice int, data binary")
        total = gather_slices(sum_slices(packed, "uint8", np.bitwise_or), 1 << bits >> 3, "uint8")
        self.sent = rows.sparkSession.sparkContext.broadcast(total.tobytes())

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = _cell(ids, self.bits)
        return (np.frombuffer(self.sent.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) == 1

    def split(self, docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """docs whose key isn't marked, or null, and those whose key is."""

        def side(hit: bool) -> DataFrame:
            def keep(batches):
                for batch in batches:
                    ids = column(batch, key)
                    marked = self.has(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                    yield batch.filter(pa.array(marked == hit))

            return docs.mapInArrow(keep, docs.schema)

        return side(False), side(True)


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone (one bigint column of that name, no nulls, cut). Rows that aren't marked pass where
    they are read; only the few others go through the anti-join."""
    clear, marked = Marks(gone, key).split(docs, key)
    return clear.unionByName(marked.join(gone, key, "left_anti").select(docs.columns))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, Arrow batches of few rows: of texts of some kB, ten thousand at once are held several times over by the executor and its Python worker.
    What is planned in it must run in it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if not 0 < int(before) <= rows:
            spark.conf.set(name, str(rows))
        yield
    finally:
        spark.conf.set(name, before)
