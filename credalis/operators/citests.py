"""Tests of conditional independence, from counts or from one Gram matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions.special import chi2_tail, f_tail, t_tail
from credalis.operators.counts import contingency, family_counts
from credalis.operators.factors import q
from credalis.plans.graph import Assertion, Independencies

#: Members of the power divergence family by name.
LAMBDAS = {"pearson": 1.0, "chi_square": 1.0, "log-likelihood": 0.0, "g_sq": 0.0, "freeman-tukey": -0.5, "mod-log-likelihood": -1.0, "modified_log_likelihood": -1.0, "neyman": -2.0, "cressie-read": 2 / 3}


def _member(lambda_: str | float) -> float:
    return LAMBDAS[lambda_] if isinstance(lambda_, str) else float(lambda_)


def divergence(table: np.ndarray, lambda_: float) -> tuple[float, int]:
    """(statistic, degrees of freedom) of one table without empty lines; with one degree the counts are moved towards the expected ones by half."""
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    if dof == 0:
        return 0.0, 0
    o = table.astype(float)
    if dof == 1:
        gap = expected - o
        o = o + np.sign(gap) * np.minimum(0.5, np.abs(gap))
    with np.errstate(divide="ignore", invalid="ignore"):
        if lambda_ == 0:
            terms = 2 * np.where(o > 0, o * np.log(o / expected), 0)
        elif lambda_ == -1:
            terms = 2 * expected * np.log(expected / o)
        elif lambda_ == 1:
            terms = (o - expected) ** 2 / expected
        else:
            terms = 2 / (lambda_ * (lambda_ + 1)) * o * ((o / expected) ** lambda_ - 1)
    return float(terms.sum()), dof


def from_counts(counts: dict[tuple, float], lambda_: float) -> tuple[float, float, int]:
    """(statistic, p, degrees of freedom) of counts by (x, y, z...): summed over the strata, each with its own levels."""
    strata: dict[tuple, dict[tuple, float]] = {}
    for k, n in counts.items():
        if n:
            strata.setdefault(k[2:], {})[k[:2]] = n
    total, dof = 0.0, 0
    for cells in strata.values():
        xs, ys = (sorted({k[i] for k in cells}, key=str) for i in (0, 1))
        table = np.zeros((len(xs), len(ys)))
        for (x, y), n in cells.items():
            table[xs.index(x), ys.index(y)] = n
        s, d = divergence(table, lambda_)
        total, dof = total + s, dof + d
    return total, chi2_tail(total, dof), dof


class CITests:
    """Independence tests of discrete data. ``prefetch`` counts many of them in one scan."""

    def __init__(self, data: DataFrame, lambda_: str | float = "chi_square"):
        self.data, self.lambda_ = data, _member(lambda_)
        self.counts: dict[frozenset[str], dict[tuple, float]] = {}
        self.jobs = 0

    def prefetch(self, tests: Iterable[tuple[str, str, Iterable[str]]]) -> None:
        missing = {frozenset((x, y, *z)) for x, y, z in tests} - set(self.counts)
        if missing:
            self.jobs += 1
            self.counts |= family_counts(self.data, missing)

    def test(self, x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float, int]:
        self.prefetch([(x, y, z)])
        family = frozenset((x, y, *z))
        return from_counts(contingency(self.counts[family], sorted(family), [x, y, *z]), self.lambda_)

    def independent(self, x: str, y: str, z: Sequence[str] = (), level: float = 0.05) -> bool:
        return self.test(x, y, z)[1] >= level


class GaussianTests:
    """(Partial) correlation; residuals of regressions without an intercept, unless ``center``."""

    def __init__(self, data: DataFrame, center: bool = False):
        from credalis.operators.gaussian import Gram

        self.gram, self.center, self.jobs = Gram.of(data), center, 1

    def prefetch(self, tests: Iterable) -> None:
        """All tests follow from the one Gram matrix."""

    def test(self, x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float, int]:
        r = self.gram.partial_correlation(x, y, list(z), self.center)
        dof = self.gram.n - 2
        return r, (0.0 if abs(r) >= 1 else t_tail(r * math.sqrt(dof / (1 - r * r)), dof)), dof

    def independent(self, x: str, y: str, z: Sequence[str] = (), level: float = 0.05) -> bool:
        return self.test(x, y, z)[1] >= level


class IndependenceMatch:
    """Answers from a given list of statements."""

    def __init__(self, statements: Independencies):
        self.statements, self.jobs = statements, 0

    def prefetch(self, tests: Iterable) -> None:
        """Nothing to count."""

    def independent(self, x: str, y: str, z: Sequence[str] = (), level: float = 0.05) -> bool:
        return self.statements.contains(Assertion(x, y, set(z)))


class CallableTests:
    """``f(x, y, z, data) -> bool`` as a test."""

    def __init__(self, f: Callable, data: DataFrame):
        self.f, self.data, self.jobs = f, data, 0

    def prefetch(self, tests: Iterable) -> None:
        """Not known what it counts."""

    def independent(self, x: str, y: str, z: Sequence[str] = (), level: float = 0.05) -> bool:
        return self.f(x, y, list(z), self.data)


def power_divergence(data: DataFrame, x: str, y: str, z: Sequence[str] = (), lambda_: str | float = 1.0) -> DataFrame:
    """One row ``(statistic, dof)``, wholly in the plan: counts, margins by windows over strata, expected counts, sums."""
    lam, z = _member(lambda_), list(z)
    cells = data.dropna(subset=[x, y, *z]).groupBy(*map(q, [*z, x, y])).agg(F.count(F.lit(1)).cast("double").alias("o"))
    zs = [q(c) for c in z]
    xs = cells.groupBy(*zs, q(x)).agg(F.sum("o").alias("nx"))
    ys = cells.groupBy(*zs, q(y)).agg(F.sum("o").alias("ny"))
    both = xs.join(ys, z) if z else xs.crossJoin(ys)
    over = Window.partitionBy(*zs)
    full = both.join(cells, [*z, x, y], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    full = full.withColumn("t", F.sum("o").over(over)).withColumn("r", F.size(F.collect_set(q(x)).over(over))).withColumn("c", F.size(F.collect_set(q(y)).over(over)))
    e = F.col("nx") * F.col("ny") / F.col("t")
    full = full.withColumn("e", e).withColumn("d", (F.col("r") - 1) * (F.col("c") - 1))
    gap = F.col("e") - F.col("o")
    o = F.when(F.col("d") == 1, F.col("o") + F.signum(gap) * F.least(F.lit(0.5), F.abs(gap))).otherwise(F.col("o"))
    full = full.withColumn("o", o).filter("d > 0")
    if lam == 0:
        term = F.when(F.col("o") > 0, 2 * F.col("o") * F.log(F.col("o") / F.col("e"))).otherwise(0.0)
    elif lam == -1:
        term = F.when(F.col("o") > 0, 2 * F.col("e") * F.log(F.col("e") / F.nullif(F.col("o"), F.lit(0.0)))).otherwise(F.lit(math.inf))
    elif lam == 1:
        term = F.pow(F.col("o") - F.col("e"), 2) / F.col("e")
    else:
        ratio = F.pow(F.col("o") / F.col("e"), F.lit(lam))
        term = F.lit(2 / (lam * (lam + 1))) * F.col("o") * (ratio - 1)
    return full.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("statistic"), F.coalesce(F.sum(F.col("d") / (F.col("r") * F.col("c"))), F.lit(0.0)).alias("dof")).select("statistic", F.round("dof").cast("long").alias("dof"))


def pillai_trace(data: DataFrame, x: Sequence[str] | str, y: Sequence[str] | str, z: Sequence[str] = ()) -> tuple[float, float]:
    """(Pillai's trace, p) of the residuals of x and y given z. Strings are coded as indicators; residuals are those of least
    squares with an intercept, all from one Gram matrix."""
    from credalis.operators.gaussian import Gram, indicators

    xs, ys = ([x] if isinstance(x, str) else list(x)), ([y] if isinstance(y, str) else list(y))
    coded, names = indicators(data, [*xs, *ys, *z])
    gram = Gram.of(coded)
    px, py, pz = ([n for v in part for n in names[v]] for part in (xs, ys, list(z)))
    sxx, syy, sxy = (gram.residual_cov(a, b, pz) for a, b in ((px, px), (py, py), (px, py)))
    corr = np.linalg.pinv(sxx) @ sxy @ np.linalg.pinv(syy) @ sxy.T
    trace = float(np.trace(corr))
    p, m, n = len(px), len(py), gram.n
    s = min(p, m)
    d1, d2 = s * max(p, m), s * (n - 1 + s - p - m)
    stat = trace / d1 * d2 / max(s - trace, 1e-300)
    return trace, f_tail(stat, d1, d2)


def mutual_information(data: DataFrame, x: str, y: str, z: Sequence[str] = ()) -> DataFrame:
    """One row ``(mi)``: (conditional) mutual information in nats."""
    z = list(z)
    zs = [q(c) for c in z]
    cells = data.dropna(subset=[x, y, *z]).groupBy(*zs, q(x), q(y)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*zs, *c))
    full = cells.withColumn("nx", over(q(x))).withColumn("ny", over(q(y))).withColumn("nz", over()).withColumn("t", F.sum("n").over(Window.partitionBy()))
    return full.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("nz") / (F.col("nx") * F.col("ny")))).alias("mi"))
