"""Discrete factors as DataFrames: a column for each variable, and ``value``.

A factor lists every combination of its variables' states. Products are joins on the shared variables, sums and maxima
over variables are grouped aggregates, evidence is a filter. Factors made from values are local relations of known size,
so Catalyst broadcasts them by itself.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credalis.functions.random import uniform
from credalis.functions.storage import written

VALUE = "value"
#: Combinations of states that the driver lists.
LOCAL_ROWS = 100_000


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def relation(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    """A local relation, whose size the optimizer knows."""
    return spark.createDataFrame(pa.table({k: pa.array(list(v)) for k, v in columns.items()}))


class Factor:
    """``df`` has the columns ``variables`` and ``value``; ``states`` lists the states of each variable in order."""

    def __init__(self, df: DataFrame, variables: Sequence[str], states: dict[str, list]):
        self.df, self.variables, self.states = df, list(variables), {v: list(states[v]) for v in variables}

    @classmethod
    def of(cls, spark: SparkSession, variables: Sequence[str], values: Iterable[float], states: dict[str, list] | None = None, cards: Sequence[int] | None = None) -> Factor:
        """From values in row-major order: the last variable varies fastest."""
        states = states or {v: list(range(c)) for v, c in zip(variables, cards, strict=True)}
        values = np.asarray(values, float).ravel()
        grid = list(itertools.product(*(states[v] for v in variables)))
        if len(grid) != len(values):
            raise ValueError(f"{len(values)} values for {len(grid)} combinations of states")
        columns = {v: [g[i] for g in grid] for i, v in enumerate(variables)}
        return Factor(relation(spark, columns | {VALUE: values}), variables, states)

    @property
    def scope(self) -> set[str]:
        return set(self.variables)

    @property
    def cardinality(self) -> dict[str, int]:
        return {v: len(s) for v, s in self.states.items()}

    def _like(self, df: DataFrame, variables: Sequence[str] | None = None, states: dict[str, list] | None = None) -> Factor:
        variables = self.variables if variables is None else list(variables)
        return Factor(df.select(*map(q, variables), VALUE), variables, states or self.states)

    def _check(self, variables: Iterable[str]) -> list[str]:
        some = [variables] if isinstance(variables, str) else list(variables)
        if missing := [v for v in some if v not in self.states]:
            raise ValueError(f"not in scope: {missing}")
        return some

    def _pair(self, other: Factor, how: str = "inner") -> tuple[DataFrame, list[str]]:
        shared = [v for v in self.variables if v in other.states]
        right = other.df.withColumnRenamed(VALUE, "_other")
        both = self.df.join(right, shared, how) if shared else self.df.crossJoin(right)
        return both, self.variables + [v for v in other.variables if v not in self.states]

    def product(self, other: Factor | float) -> Factor:
        if not isinstance(other, Factor):
            return self._like(self.df.withColumn(VALUE, q(VALUE) * F.lit(float(other))))
        both, scope = self._pair(other)
        return Factor(both.withColumn(VALUE, q(VALUE) * q("_other")).select(*map(q, scope), VALUE), scope, other.states | self.states)

    __mul__ = product

    def divide(self, other: Factor) -> Factor:
        """0 / 0 is 0 and x / 0 infinite; the divisor's variables must be among this factor's."""
        if not other.scope <= self.scope:
            raise ValueError("the divisor has other variables")
        both, scope = self._pair(other)
        n, d = q(VALUE), q("_other")
        return self._like(both.withColumn(VALUE, F.when(d == 0, F.when(n == 0, 0.0).otherwise(F.lit(math.inf) * F.signum(n))).otherwise(n / F.nullif(d, F.lit(0.0)))), scope)

    __truediv__ = divide

    def plus(self, other: Factor | float) -> Factor:
        if not isinstance(other, Factor):
            return self._like(self.df.withColumn(VALUE, q(VALUE) + F.lit(float(other))))
        both, scope = self._pair(other)
        return Factor(both.withColumn(VALUE, q(VALUE) + q("_other")).select(*map(q, scope), VALUE), scope, other.states | self.states)

    __add__ = plus

    def _fold(self, variables: Iterable[str], how) -> Factor:
        out = set(self._check(variables))
        keep = [v for v in self.variables if v not in out]
        return self._like(self.df.groupBy(*map(q, keep)).agg(how(VALUE).alias(VALUE)), keep)

    def marginalize(self, variables: Iterable[str]) -> Factor:
        return self._fold(variables, F.sum)

    def maximize(self, variables: Iterable[str]) -> Factor:
        return self._fold(variables, F.max)

    def reduce(self, evidence: dict[str, object]) -> Factor:
        """The slice at the evidence, without its variables."""
        self._check(evidence)
        df = self.df
        for v, s in evidence.items():
            df = df.filter(q(v) == F.lit(self.state(v, s)))
        return self._like(df, [v for v in self.variables if v not in evidence])

    def state(self, variable: str, s: object) -> object:
        """A state by name, else by number."""
        states = self.states[variable]
        if s in states:
            return s
        if isinstance(s, int) and 0 <= s < len(states):
            return states[s]
        raise ValueError(f"{s!r} is no state of {variable}")

    def normalize(self) -> Factor:
        return self._like(self.df.withColumn(VALUE, q(VALUE) / F.sum(VALUE).over(Window.partitionBy())))

    def fingerprint(self, digits: int = 8) -> int:
        """Equal for factors with equal variables and values (to so many digits), whatever their order."""
        row = F.xxhash64(*[F.concat_ws("=", F.lit(v), q(v).cast("string")) for v in sorted(self.variables)], F.round(VALUE, digits) + F.lit(0.0))
        return int(self.df.agg(F.sum(row.cast("decimal(38,0)"))).first()[0] or 0)

    def text(self, digits: int = 4, rows: int = 1000) -> str:
        """The first ``rows`` of the table in row-major order, for reading."""
        lines = [[*self.variables, VALUE]] + [[*(str(r[v]) for v in self.variables), f"{r[VALUE]:.{digits}f}"] for r in self.df.orderBy(*self.rank()).limit(rows).collect()]
        wide = [max(len(x[i]) for x in lines) for i in range(len(lines[0]))]
        rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
        body = ["| " + " | ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)) + " |" for line in lines]
        return "\n".join([rule, body[0], rule, *body[1:], rule])

    def settled(self) -> Factor:
        """The same values without their history: a local relation, or a written table where there are many."""
        if math.prod(len(s) for s in self.states.values()) <= LOCAL_ROWS:
            return self._like(self.df.sparkSession.createDataFrame(self.df.toArrow()))
        return self._like(written(self.df))

    def identity(self) -> Factor:
        return self._like(self.df.withColumn(VALUE, F.lit(1.0)))

    def rank(self) -> list[Column]:
        """The position of a row's states, for row-major order."""
        return [F.array_position(F.array(*[F.lit(s) for s in self.states[v]]), q(v)) for v in self.variables]

    def argmax(self) -> dict[str, object]:
        """The states of the largest value; of ties the first in row-major order."""
        row = self.df.orderBy(F.desc(VALUE), *self.rank()).limit(1).collect()[0]
        return {v: row[v] for v in self.variables}

    def get_value(self, **at: object) -> float:
        return self.reduce(at).df.collect()[0][VALUE]

    def set_value(self, value: float, **at: object) -> Factor:
        here = F.lit(True)
        for v, s in at.items():
            here = here & (q(v) == F.lit(self.state(v, s)))
        return self._like(self.df.withColumn(VALUE, F.when(here, float(value)).otherwise(q(VALUE))))

    def assignment(self, indices: Iterable[int]) -> list[list[tuple[str, object]]]:
        """The states at positions of the row-major order."""
        out = []
        for i in indices:
            row = []
            for v in reversed(self.variables):
                i, k = divmod(int(i), len(self.states[v]))
                row.append((v, self.states[v][k]))
            out.append(row[::-1])
        return out

    def values(self) -> np.ndarray:
        """The values as an array with one axis for each variable. For small factors: they are brought to the driver."""
        out = np.zeros([len(self.states[v]) for v in self.variables])
        place = {v: {s: i for i, s in enumerate(self.states[v])} for v in self.variables}
        for r in self.df.collect():
            out[tuple(place[v][r[v]] for v in self.variables)] = r[VALUE]
        return out

    def equals(self, other: Factor, atol: float = 1e-8) -> bool:
        if self.scope != other.scope or any(set(self.states[v]) != set(other.states[v]) for v in self.variables):
            return False
        both = self.df.join(other.df.withColumnRenamed(VALUE, "_other"), self.variables, "full") if self.variables else self._pair(other)[0]
        return both.filter(q(VALUE).isNull() | q("_other").isNull() | (F.abs(q(VALUE) - q("_other")) > atol)).isEmpty()

    def sample(self, n: int, seed: int = 0, keep_id: bool = False) -> DataFrame:
        """``n`` draws of the states, by the inverse of the cumulated values; ``keep_id``: with their numbers as ``_id``."""
        rows = self.df.orderBy(*self.rank()).collect()
        total = np.cumsum([r[VALUE] for r in rows])
        cum = F.array(*[F.lit(float(x)) for x in total / total[-1]])
        u = uniform(F.col("id"), seed)
        base = self.df.sparkSession.range(n).withColumn("_u", u)
        at = F.least(F.size(F.filter(cum, lambda c: c <= q("_u"))), F.lit(len(rows) - 1)) + 1
        own = [F.col("id").alias("_id")] if keep_id else []
        return base.withColumn("_k", at).select(*own, *[F.element_at(F.array(*[F.lit(r[v]) for r in rows]), q("_k")).alias(v) for v in self.variables])

    @classmethod
    def from_data(cls, data: DataFrame, variables: Sequence[str], states: dict[str, list] | None = None) -> Factor:
        """Counts of all combinations in the data."""
        states = states or {v: [r[0] for r in data.select(q(v)).filter(q(v).isNotNull()).distinct().orderBy(q(v)).collect()] for v in variables}
        counts = data.dropna(subset=list(variables)).groupBy(*map(q, variables)).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        return Factor(grid(data.sparkSession, variables, states).join(counts, list(variables), "left").select(*map(q, variables), F.coalesce("_n", F.lit(0.0)).alias(VALUE)), variables, states)


def grid(spark: SparkSession, variables: Sequence[str], states: dict[str, list]) -> DataFrame:
    """All combinations of the states; many of them are made by Spark."""
    if math.prod(len(states[v]) for v in variables) > LOCAL_ROWS:
        parts = sorted(variables, key=lambda v: -len(states[v]))
        out = relation(spark, {parts[0]: states[parts[0]]}).repartition(spark.sparkContext.defaultParallelism)
        for v in parts[1:]:
            # one row for each state
            out = out.crossJoin(F.broadcast(relation(spark, {v: states[v]})))
        return out.select(*map(q, variables))
    rows = list(itertools.product(*(states[v] for v in variables)))
    return relation(spark, {v: [r[i] for r in rows] for i, v in enumerate(variables)}) if variables else spark.range(1).select()


def product(*factors: Factor) -> Factor:
    out = factors[0]
    for f in factors[1:]:
        out = out.product(f)
    return out


def sum_product(keep: Sequence[str], factors: Sequence[Factor], how=F.sum) -> Factor:
    """Joins the factors and folds all other variables."""
    out = product(*factors)
    return out._fold([v for v in out.variables if v not in set(keep)], how)


class CPD(Factor):
    """A conditional probability table of ``variable`` given ``parents``; each parent configuration sums to 1."""

    def __init__(self, df: DataFrame, variable: str, parents: Sequence[str], states: dict[str, list]):
        super().__init__(df, [variable, *parents], states)
        self.variable, self.parents = variable, list(parents)

    @classmethod
    def table(cls, spark: SparkSession, variable: str, rows: Sequence[Sequence[float]], parents: Sequence[str] = (), states: dict[str, list] | None = None, cards: Sequence[int] = ()) -> CPD:
        """From one row for each state of the variable and one column for each parent configuration, the last parent fastest."""
        values = np.asarray(rows, float)
        states = states or {variable: list(range(len(values)))} | {p: list(range(c)) for p, c in zip(parents, cards, strict=True)}
        return CPD(Factor.of(spark, [variable, *parents], values, states).df, variable, parents, states)

    @classmethod
    def random(cls, spark: SparkSession, variable: str, parents: Sequence[str] = (), states: dict[str, list] | None = None, seed: int | None = 42) -> CPD:
        shape = len(states[variable]), math.prod(len(states[p]) for p in parents)
        values = np.random.default_rng(seed).random(shape)
        return cls.table(spark, variable, values / values.sum(0), parents, states)

    def _per_parent(self, df: DataFrame, parents: Sequence[str]) -> DataFrame:
        return df.withColumn(VALUE, q(VALUE) / F.sum(VALUE).over(Window.partitionBy(*map(q, parents))))

    def _cpd(self, df: DataFrame, parents: Sequence[str]) -> CPD:
        names = [self.variable, *parents]
        return CPD(df.select(*map(q, names), VALUE), self.variable, parents, self.states)

    def normalize(self) -> CPD:
        return self._cpd(self._per_parent(self.df, self.parents), self.parents)

    def marginalize(self, variables: Iterable[str]) -> CPD:
        """Sums over parents and normalises: the plain mean over their states."""
        out = set(self._check(variables))
        if self.variable in out:
            raise ValueError("the variable of a table can't be summed out")
        keep = [p for p in self.parents if p not in out]
        df = self.df.groupBy(q(self.variable), *map(q, keep)).agg(F.sum(VALUE).alias(VALUE))
        return self._cpd(self._per_parent(df, keep), keep)

    def reduce(self, evidence: dict[str, object]) -> CPD:
        if self.variable in evidence:
            raise ValueError("the variable of a table can't be given")
        f = self.to_factor().reduce(evidence)
        keep = [p for p in self.parents if p not in evidence]
        return self._cpd(self._per_parent(f.df, keep), keep)

    def to_factor(self) -> Factor:
        return Factor(self.df, self.variables, self.states)

    def reorder_parents(self, parents: Sequence[str]) -> CPD:
        if set(parents) != set(self.parents):
            raise ValueError("other parents than before")
        return self._cpd(self.df, parents)

    def is_valid(self, atol: float = 0.01) -> bool:
        return self.df.groupBy(*map(q, self.parents)).agg(F.sum(VALUE).alias("s")).filter(F.abs(F.col("s") - 1) > atol).isEmpty()

    def rows(self) -> np.ndarray:
        """One row for each state, one column for each parent configuration."""
        return self.values().reshape(len(self.states[self.variable]), -1)

    def to_csv(self, path: str) -> None:
        self.df.coalesce(1).write.csv(path, header=True)


class JointDistribution(Factor):
    """A factor that sums to 1."""

    @classmethod
    def of(cls, spark: SparkSession, variables: Sequence[str], values: Iterable[float], states: dict[str, list] | None = None, cards: Sequence[int] | None = None) -> JointDistribution:
        f = Factor.of(spark, variables, values, states, cards)
        if abs(float(np.sum(np.asarray(values, float))) - 1) > 1e-3:
            raise ValueError("the values don't sum to 1")
        return cls(f.df, f.variables, f.states)

    def marginal_distribution(self, variables: Sequence[str]) -> JointDistribution:
        f = self.marginalize([v for v in self.variables if v not in variables])
        return JointDistribution(f.df, f.variables, f.states)

    def conditional_distribution(self, evidence: dict[str, object]) -> JointDistribution:
        f = self.reduce(evidence).normalize()
        return JointDistribution(f.df, f.variables, f.states)

    def check_independence(self, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), atol: float = 1e-8) -> bool:
        """Whether P(x, y, z) P(z) = P(x, z) P(y, z)."""
        xyz, xz, yz = (self.marginal_distribution([*a, *z]) for a in ([*x, *y], x, y))
        left = xyz.product(self.marginal_distribution(list(z))) if z else xyz
        return left.equals(xz.product(yz), atol)

    def independencies(self, given: dict[str, object] | None = None) -> list[tuple[str, str]]:
        """The pairs of variables that are independent, under the given states if any."""
        own = self.conditional_distribution(given) if given else self
        return [(u, v) for u, v in itertools.combinations(own.variables, 2) if own.check_independence([u], [v])]

    def minimal_imap(self, order: Sequence[str]):
        """The DAG that gives each variable the fewest of its predecessors that make it independent of the rest."""
        from credalis.plans.graph import DAG

        dag = DAG(nodes=order)
        for i, v in enumerate(order):
            before = list(order[:i])
            for k in range(i + 1):
                found = next((s for s in itertools.combinations(before, k) if not (rest := [u for u in before if u not in s]) or self.check_independence([v], rest, list(s))), None)
                if found is not None:
                    for u in found:
                        dag.add_edge(u, v)
                    break
        return dag


class FactorSet:
    """A product of factors that is kept apart."""

    def __init__(self, *factors: Factor):
        self.factors = list(factors)

    def product(self, other: FactorSet) -> FactorSet:
        return FactorSet(*self.factors, *other.factors)

    def divide(self, other: FactorSet) -> FactorSet:
        return FactorSet(*self.factors, *(f.identity().divide(f) for f in other.factors))

    def marginalize(self, variables: Sequence[str]) -> FactorSet:
        some = set(variables)
        touched = [f for f in self.factors if f.scope & some]
        rest = [f for f in self.factors if not f.scope & some]
        if not touched:
            return FactorSet(*rest)
        joint = product(*touched)
        return FactorSet(*rest, joint.marginalize([v for v in joint.variables if v in some]))


class FactorDict(dict):
    """Factors by clique, with sums, scaling and the inner product over all of them."""

    @classmethod
    def from_data(cls, data: DataFrame, cliques: Iterable[Sequence[str]], states: dict[str, list] | None = None) -> FactorDict:
        return cls({tuple(c): Factor.from_data(data, c, states) for c in cliques})

    def scaled(self, k: float) -> FactorDict:
        return FactorDict({c: f.product(k) for c, f in self.items()})

    def plus(self, other: FactorDict) -> FactorDict:
        return FactorDict({c: f.plus(other[c]) for c, f in self.items()})

    def minus(self, other: FactorDict) -> FactorDict:
        return self.plus(other.scaled(-1.0))

    def dot(self, other: FactorDict) -> float:
        return sum(f.product(other[c]).df.agg(F.sum(VALUE)).first()[0] for c, f in self.items())

    def product(self) -> Factor:
        return product(*self.values())
