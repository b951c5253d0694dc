"""Content-defined chunks of byte columns: the one operator that needs numpy.

A chunk takes at least ``min_size`` bytes untested, then ends after the first byte where the Gear hash's low log2(avg_size) bits are
0, at ``max_size`` at the latest, or where the content ends. These bits depend on the last log2(avg_size) bytes alone, so all
possible ends of a batch are found by a few shifted additions over its bytes, and each content is then walked from end to end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.hashing import GEAR


@dataclass(frozen=True)
class ChunkConfig:
    min_size: int = 2048
    avg_size: int = 8192
    max_size: int = 65536

    def __post_init__(self):
        if self.avg_size <= 0 or self.avg_size & (self.avg_size - 1):
            raise ValueError("avg_size must be a positive power of two")
        if self.min_size < 0 or self.max_size <= 0:
            raise ValueError("sizes must be positive")


#: For the test tables, whose documents are short.
SMALL = ChunkConfig(512, 1024, 4096)


def sequential_cuts(data: bytes, cfg: ChunkConfig) -> list[int]:
    """The ends, byte by byte: for configurations whose untested part is shorter than the hash's reach."""
    ends, s, n, mask = [], 0, len(data), cfg.avg_size - 1
    gear = [int(g) & mask for g in GEAR]
    while s < n:
        at, h = min(s + cfg.min_size, n), 0
        for byte in data[s:at]:
            h = (h << 1) + gear[byte] & mask
        limit = min(s + cfg.max_size, n)
        while at < limit:
            h = (h << 1) + gear[data[at]] & mask
            at += 1
            if h == 0:
                break
        ends.append(at)
        s = at
    return ends


def possible_cuts(data: np.ndarray, cfg: ChunkConfig) -> np.ndarray:
    """Offsets after which the hash is 0, whatever is before its reach."""
    reach = cfg.avg_size.bit_length() - 1
    kind = np.uint16 if reach <= 16 else np.uint32 if reach <= 32 else np.uint64
    mask = kind(cfg.avg_size - 1)
    table = (GEAR & np.uint64(cfg.avg_size - 1)).astype(kind)
    g = table[data]
    h = np.zeros(len(data), kind)
    for j in range(min(reach, len(data))):
        h[j:] += g[: len(g) - j] << kind(j)
    return np.flatnonzero((h & mask) == 0) + 1


def cuts(data: bytes | np.ndarray, cfg: ChunkConfig, possible: np.ndarray | None = None) -> list[int]:
    """The ends of the chunks; ``possible`` holds ends relative to data."""
    n = len(data)
    if cfg.min_size + 1 < cfg.avg_size.bit_length() - 1:
        return sequential_cuts(bytes(data), cfg)
    if possible is None:
        possible = possible_cuts(np.frombuffer(data, np.uint8), cfg)
    ends, s = [], 0
    while s < n:
        if cfg.min_size >= cfg.max_size:
            e = min(s + cfg.min_size, n)
        else:
            e = min(s + cfg.max_size, n)
            k = int(np.searchsorted(possible, s + cfg.min_size + 1))
            if k < len(possible) and possible[k] < e:
                e = int(possible[k])
        ends.append(e)
        s = e
    return ends


def chunk(df: DataFrame, key: str, content: str, cfg: ChunkConfig = ChunkConfig(), with_data: bool = False) -> DataFrame:
    """(key, ordinal, file_offset, size, digest[, data]) of every chunk; null and empty contents have none."""
    kind = dict(df.dtypes)[key]
    names = [key, "ordinal", "file_offset", "size", "digest"] + ["data"] * with_data

    def scan(batches):
        for batch in batches:
            keys = batch.column(0)
            rows, order, at, size, digest, data = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                if not value.is_valid:
                    continue
                raw = value.as_buffer()
                view = memoryview(raw)
                s = 0
                for k, e in enumerate(cuts(view, cfg)):
                    rows.append(i), order.append(k), at.append(s), size.append(e - s)
                    digest.append(hashlib.sha256(view[s:e]).hexdigest())
                    if with_data:
                        data.append(bytes(view[s:e]))
                    s = e
            arrays = [keys.take(pa.array(rows, pa.int64())), pa.array(order, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(data, pa.binary())] * with_data, names)

    schema = f"`{key}` {kind}, ordinal bigint, file_offset bigint, size bigint, digest string" + ", data binary" * with_data
    return df.select(key, content).mapInArrow(scan, schema)


def document_chunks(docs: DataFrame, cfg: ChunkConfig = SMALL, with_data: bool = False) -> DataFrame:
    return chunk(docs.select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id", "content", cfg, with_data)


def cdc_sql(cfg: ChunkConfig = SMALL, source: str = "documents", key: str = "doc_id", text: str = "text", name: str = "cdc") -> str:
    """CTEs that end in ``name`` (key, ordinal, file_offset, size, digest), for a statement that begins "with recursive"."""
    reach = cfg.avg_size.bit_length() - 1
    gear = ", ".join(f"('{k:02X}', {int(g) & (cfg.avg_size - 1)})" for k, g in enumerate(GEAR))
    terms = " + ".join(f"coalesce(lag(gv, {j}) over w, 0) * {1 << j}" for j in range(reach)) or "0"
    nxt = f"coalesce(list_min(list_filter(es, lambda x: x >= {{s}} + {cfg.min_size + 1} and x <= least({{s}} + {cfg.max_size}, n))), least({{s}} + {cfg.max_size}, n))"
    p = name
    return f"""{p}_gear(byte, gv) as (values {gear}),
{p}_d as (select {key}, hex(encode({text})) as hx, octet_length(encode({text})) as n from {source} where octet_length(encode({text})) > 0),
{p}_b as (select {key}, unnest(regexp_extract_all(hx, '..')) as byte, unnest(range(n)) as p from {p}_d),
{p}_g as (select {key}, p, gv from {p}_b join {p}_gear using (byte)),
{p}_h as (select {key}, p + 1 as e, ({terms}) % {cfg.avg_size} as h from {p}_g window w as (partition by {key} order by p)),
{p}_e as (select d.{key}, any_value(d.n) as n, coalesce(list(e order by e) filter (h = 0 and e >= {reach}), []) as es from {p}_d d join {p}_h h on d.{key} = h.{key} group by d.{key}),
{p}_w as (select {key}, 0::bigint as ordinal, 0::bigint as s, {nxt.format(s="0")} as e, n, es from {p}_e
  union all select {key}, ordinal + 1, e, {nxt.format(s="e")}, n, es from {p}_w where e < n),
{name} as (select w.{key}, ordinal, s as file_offset, (e - s)::bigint as size, sha256(unhex(substr(hx, (2 * s + 1)::bigint, (2 * (e - s))::bigint))) as digest from {p}_w w join {p}_d d on w.{key} = d.{key})"""
