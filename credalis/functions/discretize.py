"""Classes of a continuous column, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width(data: DataFrame, column: str, bins: int) -> Column:
    """Right-closed classes 0 to ``bins - 1`` of equal width; the smallest value is in the first."""
    lo, hi = data.agg(F.min(column), F.max(column)).first()
    if lo is None or hi == lo:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    width = (float(hi) - float(lo)) / bins
    at = F.least(F.greatest(F.ceil((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(1)), F.lit(bins)).cast("int") - 1
    return F.when(F.col(column).isNotNull(), at)


def equal_frequency(data: DataFrame, column: str, bins: int) -> Column:
    """Right-closed classes with about as many rows each, by exact quantiles."""
    cuts = data.agg(F.percentile(column, F.array(*[F.lit(k / bins) for k in range(1, bins)]))).first()[0] or []
    return by_cuts(column, cuts)


def by_cuts(column: str, cuts: Sequence[float]) -> Column:
    out: Column = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        out = F.when(F.col(column) <= F.lit(float(c)), F.lit(i)).otherwise(out)
    return F.when(F.col(column).isNotNull(), out)
