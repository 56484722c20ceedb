"""Random numbers as hashes of a row's key: the same whatever the partitioning, also when a lost task is run again."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), by the row's key and the seed. Two rounds: streams of neighbouring seeds are unrelated."""
    h = F.xxhash64(F.xxhash64(key, F.lit(seed).cast("long")), F.lit(seed * 7919 + 17).cast("long"))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def normal(key: Column, seed: int) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(key, 2 * seed))) * F.cos(F.lit(2 * math.pi) * uniform(key, 2 * seed + 1))
