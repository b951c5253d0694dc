"""Streams of files into a store, one snapshot a micro-batch; and a bounded-memory stream of first sightings.

A digest may come back at any time, so an exact stream can't forget: ``into_store`` keeps its memory in the store. ``first_sightings`` drops a
digest after ``delay`` and is approximate: a chunk that returns later is told again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chunkwright.operators.chunking import ChunkConfig, chunk
from chunkwright.operators.store import Store


def into_store(files: DataFrame, store: Store, checkpoint: str, label: str = "stream") -> StreamingQuery:
    """files: a stream of (path, content). A batch that is run again after a failure adds nothing twice, as files count once a label."""

    def add(batch: DataFrame, _: int) -> None:
        store.ingest(batch, label, once=True)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(files: DataFrame, time: str, cfg: ChunkConfig, delay: str = "1 hour") -> DataFrame:
    """files: a stream of (path, content, time). (path, ..., digest, time) of chunks not seen within the delay."""
    from pyspark.sql import functions as F

    key = F.to_json(F.struct("path", F.col(time).alias("t")))
    cut = chunk(files.withColumn("_key", key), "_key", "content", cfg)
    parsed = F.from_json("_key", "path string, t timestamp")
    cut = cut.withColumns({"path": parsed["path"], time: parsed["t"]}).drop("_key")
    return cut.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])
