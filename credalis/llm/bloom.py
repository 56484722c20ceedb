"""Bloom filters of bounded size: built by an aggregate, probed with arrays.

A filter is a power of two of bits, at most ``MAX_BITS``. Where more keys go in than it can tell apart it lets more
keys through; callers use it only to spare rows a shuffle, so their results don't depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter that is broadcast (8 MB).
MAX_BITS = 1 << 26
PROBES = 4


def bits_for(n: int) -> int:
    """Sixteen bits a key, within the bounds."""
    return min(MAX_BITS, 1 << max(10, (16 * n - 1).bit_length()))


def _positions(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    second = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * second) & np.uint64(n_bits - 1)).astype(np.int64) for k in range(PROBES)]


def build(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(n_bits // 8, np.uint8)
    for p in _positions(hashes, n_bits):
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    found = np.ones(len(hashes), bool)
    for p in _positions(hashes, len(bits) * 8):
        found &= (bits[p >> 3] >> (p & 7) & 1).astype(bool)
    return found


def build_distributed(keys: DataFrame, high: Column, low: Column) -> bytes:
    """The filter of the 64-bit hashes whose halves are ``high`` and ``low`` (as longs). Its words are combined by an
    aggregate, so the driver gets at most ``MAX_BITS / 32`` numbers however many keys there are."""
    n_bits = bits_for(keys.count())
    # n_bits is at most 2**26, so the low halves decide every position
    spots = keys.select(F.explode(F.array(*[(low + F.lit(k) * high.bitwiseOR(F.lit(1))).bitwiseAND(F.lit(n_bits - 1)) for k in range(PROBES)])).alias("p"))
    words = spots.groupBy((F.col("p") / 32).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("v")).collect()
    out = np.zeros(n_bits // 32, np.uint32)
    for r in words:
        out[r.w] = r.v
    return out.astype("<u4").tobytes()


def halves(hash64: Column) -> tuple[Column, Column]:
    """The halves of a long, as non-negative longs."""
    return F.shiftrightunsigned(hash64, 32), hash64.bitwiseAND(F.lit(0xFFFFFFFF))
