"""Sufficient statistics: counts of families in one scan, by grouping sets."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.operators.factors import grid, q


def state_names(data: DataFrame, variables: Sequence[str]) -> dict[str, list]:
    """The sorted states of each variable, without nulls: one scan for all."""
    row = data.agg(*[F.sort_array(F.collect_set(q(v))).alias(f"s{i}") for i, v in enumerate(variables)]).first()
    return {v: list(row[i]) for i, v in enumerate(variables)}


def state_counts(data: DataFrame, variable: str, parents: Sequence[str] = (), weight: str | None = None, states: dict[str, list] | None = None) -> DataFrame:
    """``(variable, parents..., n)``; with ``states``, all combinations, unseen ones with 0. Rows with a null in the family are left out."""
    family = [variable, *parents]
    n = F.sum(q(weight)) if weight else F.count(F.lit(1))
    out = data.dropna(subset=family).groupBy(*map(q, family)).agg(n.alias("n"))
    if states is None:
        return out
    return grid(data.sparkSession, family, states).join(out, family, "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Grouping sets in one query; more are asked for in further queries.
SETS_PER_QUERY = 48


def family_counts(data: DataFrame, families: Iterable[Iterable[str]], weight: str | None = None) -> dict[frozenset[str], dict[tuple, float]]:
    """Counts of every family (a set of variables), keyed by its states in sorted order of the variables' names.

    The families are the grouping sets of as few queries as ``SETS_PER_QUERY`` allows; rows with a null in a family
    don't count for it. The result is one row for each combination that occurs, so it stays small for discrete data.
    """
    wanted = sorted({tuple(sorted(f)) for f in families})
    out: dict[frozenset[str], dict[tuple, float]] = {frozenset(f): defaultdict(float) for f in wanted}
    n = F.sum(q(weight)) if weight else F.count(F.lit(1))
    if () in wanted:
        out[frozenset()][()] = data.agg(n).first()[0] or 0
    sets = [f for f in wanted if f]
    for lo in range(0, len(sets), SETS_PER_QUERY):
        part = sets[lo : lo + SETS_PER_QUERY]
        names = sorted({v for f in part for v in f})
        missing = [q(v).isNull().cast("int").alias(f"_null{i}") for i, v in enumerate(names)]
        rows = data.select(*map(q, names), *missing, *([q(weight)] if weight else []))
        flags = [f"_null{i}" for i in range(len(names))]
        place = {v: i for i, v in enumerate(names)}
        # a null of the data has its flag set; a null of another grouping set has no flag
        grouped = rows.groupingSets([[*map(q, f), *(F.col(flags[place[v]]) for v in f)] for f in part], *map(q, names), *map(F.col, flags)).agg(n.alias("_n"))
        for r in grouped.collect():
            family = [v for v in names if r[flags[place[v]]] is not None]
            if not any(r[flags[place[v]]] for v in family):
                out[frozenset(family)][tuple(r[v] for v in family)] += r["_n"]
    return out


def contingency(counts: dict[tuple, float], names: Sequence[str], order: Sequence[str]) -> dict[tuple, float]:
    """The counts with their keys in another order of the variables."""
    at = [list(sorted(names)).index(v) for v in order]
    return {tuple(k[i] for i in at): n for k, n in counts.items()}


def subsets(nodes: Sequence[str], most: int) -> list[tuple[str, ...]]:
    return [s for k in range(most + 1) for s in itertools.combinations(nodes, k)]
