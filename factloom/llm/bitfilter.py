"""A one-hash membership filter of fixed size, aggregated by Spark itself.

The filter holds ``2**bits`` bits whatever the input, so what reaches the
driver and is broadcast is bounded by a parameter.  It may say yes wrongly,
never no wrongly; callers treat a yes as "look closer".
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bits_for  # noqa: F401

PER_BUCKET = 32768  # bits in one bitmap of Spark's bitmap_construct_agg


def build(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bytes of a bitmap in which bit (key mod 2**bits) is set for every key."""
    spot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.select(spot.alias("spot"))
        .groupBy(F.expr("spot div 32768").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(cast(spot % 32768 as int))").alias("bitmap"))
        .collect()
    )
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bitmap), np.uint8)
        base = r.bucket * (PER_BUCKET // 8)
        out[base : base + len(part)] |= part[: len(out) - base]
    return out


def test(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 or uint64 keys may have been seen."""
    spot = keys.astype(np.uint64) & np.uint64(len(filter_bytes) * 8 - 1)
    return (filter_bytes[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
