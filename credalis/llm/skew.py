"""A join that no single key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all rows are hot. There are at most so many, so what is broadcast is bounded.
HOT = 10_000


def joined(left: DataFrame, right: DataFrame, on: list[str], count: str, spread: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys ``on`` are unique, not null and of the same types; ``how`` is inner or left.

    ``right`` says by ``count`` how many rows of ``left`` about a key has (the column doesn't come along). Hot keys are joined
    where the rows are; their rows then go through the shuffle of the others dealt by the hash of ``spread``.
    """
    values = [c for c in right.columns if c not in on and c != count]
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    near = right.filter(hot).select(*on, F.struct(*values).alias("_hot"))
    rest = right.filter(~hot).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.xxhash64(*on).alias("_s2"), F.struct(*values).alias("_cold"))
    marked = left.join(F.broadcast(near), on, "left")
    far = F.col("_hot").isNotNull()
    marked = marked.withColumns({"_s": F.when(far, F.xxhash64(*spread)).otherwise(F.xxhash64(*on))} | {f"_j{i}": F.when(~far, F.col(c)) for i, c in enumerate(on)})
    same = F.col("_s") == F.col("_s2")
    for i in range(len(on)):
        same = same & (F.col(f"_j{i}") == F.col(f"_k{i}"))
    out = marked.join(rest, same, "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return (out.filter(F.col("_v").isNotNull()) if how == "inner" else out).select(*left.columns, *[F.col("_v")[c].alias(c) for c in values])
