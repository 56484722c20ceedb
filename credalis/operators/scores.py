"""Decomposable structure scores over family counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions.special import lgamma
from credalis.operators.counts import family_counts, state_counts, state_names
from credalis.operators.factors import q
from credalis.plans.graph import DAG

Counts = dict[tuple, float]


def _split(counts: Counts, at: int) -> dict[tuple, list[float]]:
    """The counts of the variable's states by parent configuration, as observed."""
    out: dict[tuple, list[float]] = {}
    for k, n in counts.items():
        if n:
            out.setdefault(k[:at] + k[at + 1 :], []).append(n)
    return out


def k2(groups: dict[tuple, list[float]], r: int, configs: int, **_) -> float:
    g = math.lgamma
    return sum(g(n + 1) for ns in groups.values() for n in ns) - sum(g(sum(ns) + r) for ns in groups.values()) + configs * g(r)


def bdeu(groups: dict[tuple, list[float]], r: int, configs: int, ess: float = 10, **_) -> float:
    a, b, seen, g = ess / configs, ess / (configs * r), len(groups), math.lgamma
    cells = sum(g(n + b) for ns in groups.values() for n in ns) + (seen * r - sum(map(len, groups.values()))) * g(b)
    return cells - sum(g(sum(ns) + a) for ns in groups.values()) + seen * g(a) - seen * r * g(b)


def bds(groups: dict[tuple, list[float]], r: int, configs: int, ess: float = 10, **_) -> float:
    """As BDeu, with the parents' weight spread over the configurations that occur."""
    seen, g = len(groups), math.lgamma
    if not seen:
        return 0.0
    a, b = ess / seen, ess / (configs * r)
    cells = sum(g(n + b) for ns in groups.values() for n in ns) + (seen * r - sum(map(len, groups.values()))) * g(b)
    return cells + (configs - seen) * r * g(b) - sum(g(sum(ns) + a) for ns in groups.values()) + seen * g(a) - configs * r * g(b)


def _likelihood(groups: dict[tuple, list[float]]) -> float:
    return sum(n * math.log(n / total) for ns in groups.values() for total in [sum(ns)] for n in ns)


def bic(groups: dict[tuple, list[float]], r: int, configs: int, rows: int = 0, **_) -> float:
    return _likelihood(groups) - 0.5 * math.log(rows) * configs * (r - 1)


def aic(groups: dict[tuple, list[float]], r: int, configs: int, **_) -> float:
    return _likelihood(groups) - configs * (r - 1)


FORMULAS: dict[str, Callable[..., float]] = {"k2": k2, "bdeu": bdeu, "bds": bds, "bic": bic, "aic": aic}


class Score:
    """Local scores of one data set, kept by (variable, set of parents). ``prefetch`` counts many families in one scan.

    ``formula``: a name of ``FORMULAS`` or a callable of the same arguments.
    """

    def __init__(self, data: DataFrame, formula: str | Callable[..., float] = "k2", ess: float = 10, states: dict[str, list] | None = None):
        self.data, self.ess = data, ess
        self.formula = FORMULAS[formula] if isinstance(formula, str) else formula
        self.name = formula if isinstance(formula, str) else "custom"
        self.states = states or state_names(data, data.columns)
        self.rows = data.count()
        self.counts: dict[frozenset[str], Counts] = {}
        self.known: dict[tuple[str, frozenset[str]], float] = {}
        self.jobs = 0

    def prefetch(self, families: Iterable[tuple[str, Iterable[str]]]) -> None:
        missing = {frozenset((v, *p)) for v, p in families} - set(self.counts)
        if missing:
            self.jobs += 1
            self.counts |= family_counts(self.data, missing)

    def local(self, variable: str, parents: Iterable[str] = ()) -> float:
        parents = frozenset(parents)
        if (variable, parents) not in self.known:
            family = parents | {variable}
            self.prefetch([(variable, parents)])
            groups = _split(self.counts[family], sorted(family).index(variable))
            configs = math.prod(len(self.states[p]) for p in parents)
            self.known[variable, parents] = self.formula(groups, len(self.states[variable]), configs, ess=self.ess, rows=self.rows)
        return self.known[variable, parents]

    def prior(self, dag: DAG) -> float:
        """Marginal uniform graph prior of BDs; 0 for the other scores."""
        n = len(dag.nodes)
        return -(len(dag.edges) + n * (n - 1) / 2) * math.log(2) if self.name == "bds" else 0.0

    def prior_ratio(self, operation: str) -> float:
        return {"+": -math.log(2), "-": math.log(2)}.get(operation, 0.0) if self.name == "bds" else 0.0

    def score(self, dag: DAG) -> float:
        self.prefetch([(n, dag.pa[n]) for n in dag.nodes])
        return sum(self.local(n, dag.pa[n]) for n in dag.nodes) + self.prior(dag)


def local_score(data: DataFrame, variable: str, parents: Sequence[str], formula: str, ess: float = 10.0) -> DataFrame:
    """One row ``(score)``, wholly as column expressions: counts, totals by parent configuration, and the formula's sums."""
    parents = list(parents)
    states = state_names(data, [variable, *parents])
    r, configs = len(states[variable]), math.prod(len(states[p]) for p in parents)
    cells = state_counts(data, variable, parents)
    totals = cells.groupBy(*map(q, parents)).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(lgamma(F.col("n") + 1)).alias("lg1"), F.sum(lgamma(F.col("n") + ess / (configs * r))).alias("lgb"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nln"))
    g = math.lgamma
    like = F.sum(F.col("nln") - F.col("t") * F.log(F.col("t").cast("double")))
    if formula == "k2":
        out = F.sum("lg1") - F.sum(lgamma(F.col("t") + r)) + configs * g(r)
    elif formula == "bdeu":
        a, b = ess / configs, ess / (configs * r)
        out = F.sum("lgb") + F.sum((F.lit(r) - F.col("k")) * g(b)) - F.sum(lgamma(F.col("t") + a)) + F.count(F.lit(1)) * (g(a) - r * g(b))
    elif formula == "bds":
        b, n = ess / (configs * r), totals.count()
        a = ess / max(n, 1)
        out = F.sum("lgb") + F.sum((F.lit(r) - F.col("k")) * g(b)) - F.sum(lgamma(F.col("t") + a)) + F.lit(n * g(a) + (configs - n) * r * g(b) - configs * r * g(b))
    elif formula == "bic":
        out = like - F.lit(0.5 * math.log(data.count()) * configs * (r - 1))
    else:
        out = like - configs * (r - 1)
    return totals.agg(out.alias("score"))


# --- Gaussian scores ----------------------------------------------------------------------------------------------


class GaussianScore:
    """``bic-g`` or ``aic-g``: Gaussian likelihood of each variable given its parents, from one Gram matrix."""

    def __init__(self, data: DataFrame, formula: str = "bic-g"):
        from credalis.operators.gaussian import Gram

        self.gram, self.formula, self.states = Gram.of(data), formula, dict.fromkeys(data.columns)
        self.name, self.jobs = formula, 1

    def prefetch(self, families: Iterable) -> None:
        """All families follow from the one Gram matrix."""

    def local(self, variable: str, parents: Iterable[str] = ()) -> float:
        parents = sorted(parents)
        n, rss = self.gram.n, self.gram.residual_sum(variable, parents)
        like = -n / 2 * math.log(2 * math.pi * rss / n) - n / 2
        df = len(parents)
        return like - (df + 2) / 2 * math.log(n) if self.formula == "bic-g" else like - (df + 2)

    def prior_ratio(self, operation: str) -> float:
        return 0.0

    def score(self, dag: DAG) -> float:
        return sum(self.local(n, dag.pa[n]) for n in dag.nodes)
