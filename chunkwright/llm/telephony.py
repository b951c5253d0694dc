"""Telephony audio: mu-law, A-law and IMA ADPCM payloads to resampled 16-bit PCM.

mu-law and A-law bytes are expanded through tables of 256 values. ADPCM comes in blocks of BLOCK bytes (a 4-byte head: the first
sample, little-endian, the step index, a byte unused; then two samples a byte, the low half first); the blocks of all payloads of a batch
are decoded at once, numpy stepping through the samples of all blocks together. A short last block is decoded as far as it goes, one of
less than 4 bytes gives nothing.

Resampling from RATE to TARGET Hz (whole multiples) is a windowed-sinc interpolation: a polyphase filter of TAPS taps a phase over the
decoded samples, with silence before and after them; phase 0 is the sample itself. Values are rounded and clipped to 16 bits.

``decode_audio`` reads (id, codec, payload) and gives (id, codec, sample_rate, n_samples, pcm), pcm little-endian. A null payload or codec, or
a codec that isn't known, gives null pcm and 0 samples; an empty payload gives empty pcm. Repeated rows give repeated
results; ids may be null; other columns aren't read. No shuffle.

The test tables hold no audio: ``calls`` takes each document's UTF-8 bytes as a payload, the codec by doc_id modulo 3. Every byte string is
a valid payload of each of the codecs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import common as C

RATE, TARGET, TAPS, BLOCK = 8000, 16000, 16, 256
CODECS = ("mulaw", "alaw", "adpcm")


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    magnitude = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    low, segment = (a & 0x0F) << 4, (a & 0x70) >> 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
#: IMA ADPCM: each step is about a tenth more than the one before.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: By step index and half byte: the difference, and the next index.
_N = np.arange(16)
DIFF = (STEPS[:, None] >> 3) + np.where(_N & 4, STEPS[:, None], 0) + np.where(_N & 2, STEPS[:, None] >> 1, 0) + np.where(_N & 1, STEPS[:, None] >> 2, 0)
DIFF = np.where(_N & 8, -DIFF, DIFF).astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + MOVES[None, :], 0, 88).astype(np.int32).ravel()


def adpcm_blocks(payloads: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
    """The samples of each payload; all blocks of all payloads step together."""
    count = [len(p) // block + (len(p) % block >= 4) for p in payloads]
    total = sum(count)
    if not total:
        return [np.zeros(0, np.int16) for _ in payloads]
    raw = np.zeros((total, block), np.uint8)
    size = np.full(total, block)
    k = 0
    for p, c in zip(payloads, count):
        if c:
            use = np.frombuffer(p, np.uint8)[: c * block]
            raw[k : k + c].reshape(-1)[: len(use)] = use
            size[k + c - 1] = len(use) - (c - 1) * block
            k += c
    samples = 1 + 2 * (block - 4)
    out = np.empty((samples, total), np.int16)
    value = raw[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    at = 1
    for row in codes:
        for half in (row & 15, row >> 4):
            cell = index * 16 + half
            value += DIFF.take(cell)
            np.clip(value, -32768, 32767, out=value)
            index = NEXT.take(cell)
            out[at] = value
            at += 1
    flat = np.ascontiguousarray(out.T)
    result, k = [], 0
    for c in count:
        if c:
            n = (c - 1) * samples + 1 + 2 * (int(size[k + c - 1]) - 4)
            result.append(flat[k : k + c].reshape(-1)[:n])
        else:
            result.append(np.zeros(0, np.int16))
        k += c
    return result


def phases(factor: int, taps: int = TAPS) -> np.ndarray:
    """(factor, taps) weights of the samples around, of gain 1: a Hann-windowed sinc."""
    offset = np.arange(-(taps // 2) + 1, taps // 2 + 1)
    out = []
    for k in range(factor):
        x = offset - k / factor
        w = np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / (taps // 2 + 1)))
        out.append(w / w.sum())
    return np.array(out, np.float32)


def resample(samples: np.ndarray, starts: np.ndarray, factor: int) -> np.ndarray:
    """Every piece of samples (from one start to the next) times factor. The pieces lie apart in one padded array, which the filter runs over once."""
    half = TAPS // 2
    sizes = np.diff(starts)
    shift = np.repeat(half * (2 * np.arange(len(sizes)) + 1), sizes)
    spread = np.zeros(len(samples) + TAPS * len(sizes) + TAPS, np.float32)
    where = np.arange(len(samples)) + shift
    spread[where] = samples
    out = np.empty((len(samples), factor), np.int16)
    out[:, 0] = samples
    for k, weights in enumerate(phases(factor)):
        if k:
            y = np.zeros(len(spread) - TAPS, np.float32)
            base = half - 1
            for j, w in enumerate(weights):
                # Output at position i is the sum of weights times spread[i + j - base].
                if j < base:
                    y[base:] += w * spread[j : len(y) - base + j]
                else:
                    y += w * spread[j - base : j - base + len(y)]
            out[:, k] = np.clip(np.rint(y[where]), -32768, 32767)
    return out.reshape(-1)


def decode_batch(codecs: list, payloads: list, factor: int) -> list[bytes | None]:
    out: list[bytes | None] = [None] * len(payloads)
    known = [i for i, (c, p) in enumerate(zip(codecs, payloads)) if c in CODECS and p is not None]
    decoded: dict[int, np.ndarray] = {}
    for name, table in (("mulaw", MULAW), ("alaw", ALAW)):
        for i in known:
            if codecs[i] == name:
                decoded[i] = table[np.frombuffer(payloads[i], np.uint8)]
    blocks = [i for i in known if codecs[i] == "adpcm"]
    decoded.update(zip(blocks, adpcm_blocks([payloads[i] for i in blocks])))
    if known:
        pieces = [decoded[i] for i in known]
        starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
        made = resample(np.concatenate(pieces), starts, factor).astype("<i2").tobytes()
        for i, a, b in zip(known, starts[:-1].tolist(), starts[1:].tolist()):
            out[i] = made[2 * factor * a : 2 * factor * b]
    return out


def decode_audio(calls: DataFrame, rate: int = RATE, target: int = TARGET) -> DataFrame:
    if target % rate:
        raise ValueError("the target rate must be a whole multiple of the rate")
    factor = target // rate

    def scan(batches):
        for batch in batches:
            for part in C.slices(batch, "payload"):
                codecs = C.column(part, "codec").to_pylist()
                pcm = decode_batch(codecs, [p.as_buffer() if p.is_valid else None for p in C.column(part, "payload")], factor)
                n = [len(p) // 2 if p is not None else 0 for p in pcm]
                yield pa.RecordBatch.from_arrays([C.column(part, "id").cast(pa.int64()), C.column(part, "codec"), pa.array([target] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(pcm, pa.binary())], ["id", "codec", "sample_rate", "n_samples", "pcm"])

    return calls.select("id", "codec", "payload").mapInArrow(scan, "id bigint, codec string, sample_rate int, n_samples bigint, pcm binary")


def calls(docs: DataFrame) -> DataFrame:
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), codec.alias("codec"), F.encode("text", "UTF-8").alias("payload"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, codec, sample_rate, n_samples, pcm)."""
    return decode_audio(calls(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")
