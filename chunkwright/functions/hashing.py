"""Digests, seeded hashes and the rolling hash's table."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64-bit values by byte for the rolling hash; the generator and its seed make them the same everywhere.
GEAR = np.array([v for rng in [random.Random(0xC0DEC0DE)] for v in (rng.getrandbits(64) for _ in range(256))], np.uint64)


def md5_mod(seed: Column | str | int, value: Column, size: int) -> Column:
    """A seeded hash that SQL can repeat: the first 15 hex digits of md5('seed:value'), modulo size."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), value)), 1, 15), 16, 10).cast("bigint") % size


def full_md5_mod(text: Column, size: int) -> Column:
    """All 128 bits of md5 modulo size (below 2**31), 32 bits at a time."""
    digest, r = F.md5(text), F.lit(0).cast("bigint")
    for k in range(4):
        r = (r * (1 << 32) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")) % size
    return r


def stable_hash(seed: int, value: Column, size: int) -> Column:
    """8 bytes of blake2b('seed:value') as a big-endian number, modulo size; neither engine has blake2b, so Arrow batches."""

    @F.pandas_udf("bigint")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2b(f"{seed}:{v}".encode(), digest_size=8).digest(), "big") % size)

    return of(value)


def share_below(key: Column, salt: str, fraction: float) -> Column:
    """True for about this fraction of keys, always the same ones."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("bigint") < int(fraction * (1 << 32))


def format_bytes(size: Column) -> Column:
    """1536 -> '1.50 KB', by 1024, PB at most; halves are rounded to even."""
    size = size.cast("double")
    out = F.format_string("%.2f PB", F.bround(size / 1024.0**5, 2))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(F.abs(size) < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**k, 2))).otherwise(out)
    return out
