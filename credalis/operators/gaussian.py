"""Linear-Gaussian models from one Gram matrix, and Gaussian distributions on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.functions.random import normal
from credalis.operators.factors import q
from credalis.plans.graph import DAG


@dataclass
class Gram:
    """Row count, means and sums of products around the means: all that least squares needs, from two scans. The first finds
    the means, so that columns far from zero keep their digits."""

    names: list[str]
    n: int
    means: np.ndarray
    centred: np.ndarray

    @classmethod
    def of(cls, data: DataFrame, names: Sequence[str] | None = None) -> Gram:
        names = list(names or data.columns)
        rows = data.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna()
        k = len(names)
        first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
        n, at = int(first[0]), [float(x or 0) for x in first[1:]]
        off = [F.col(f"c{i}") - F.lit(m) for i, m in enumerate(at)]
        # the means are rounded: what is left of the sums is taken out again
        aggs = [F.sum(x) for x in off] + [F.sum(off[i] * off[j]) for i in range(k) for j in range(i, k)]
        flat = [float(x or 0) for x in rows.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()]
        left = np.array(flat[:k]) / max(1, n)
        products = np.zeros((k, k))
        products[np.triu_indices(k)] = flat[k:]
        return cls(names, n, np.array(at) + left, products + np.triu(products, 1).T - n * np.outer(left, left))

    @property
    def products(self) -> np.ndarray:
        """Sums of products of the columns as they are."""
        return self.centred + self.n * np.outer(self.means, self.means)

    def _at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def cov(self, names: Sequence[str] | None = None, ddof: int = 1) -> np.ndarray:
        at = self._at(names or self.names)
        return self.centred[np.ix_(at, at)] / (self.n - ddof)

    def mean(self, names: Sequence[str] | None = None) -> np.ndarray:
        return self.means[self._at(names or self.names)]

    def regress(self, target: str, on: Sequence[str]) -> tuple[float, np.ndarray, float]:
        """(intercept, slopes, residual sum of squares)."""
        full = self.cov([target, *on]) * (self.n - 1)
        slopes = np.linalg.lstsq(full[1:, 1:], full[1:, 0], rcond=None)[0] if on else np.zeros(0)
        rss = float(full[0, 0] - full[0, 1:] @ slopes)
        m = self.mean([target, *on])
        return float(m[0] - m[1:] @ slopes), slopes, max(rss, 0.0)

    def residual_sum(self, target: str, on: Sequence[str]) -> float:
        return self.regress(target, on)[2]

    def residual_cov(self, a: Sequence[str], b: Sequence[str], z: Sequence[str]) -> np.ndarray:
        """Sums of products of the residuals of a and b given z, with an intercept."""
        c = self.cov([*a, *b, *z])
        i, j = len(a), len(a) + len(b)
        return c[:i, i:j] - c[:i, j:] @ np.linalg.pinv(c[j:, j:]) @ c[j:, i:j] if z else c[:i, i:j]

    def partial_correlation(self, x: str, y: str, z: Sequence[str] = (), center: bool = False) -> float:
        """Correlation, or that of the residuals given z; regressions have an intercept only if ``center``."""
        if not z or center:
            c = self.residual_cov([x, y], [x, y], z)
            return float(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]))
        at, zs = self._at([x, y]), self._at(z)
        b = np.linalg.lstsq(self.products[np.ix_(zs, zs)], self.products[np.ix_(zs, at)], rcond=None)[0]
        sums = self.sums[at] - self.sums[zs] @ b
        prod = self.products[np.ix_(at, at)] - self.products[np.ix_(at, zs)] @ b - b.T @ self.products[np.ix_(zs, at)] + b.T @ self.products[np.ix_(zs, zs)] @ b
        c = prod - np.outer(sums, sums) / self.n
        return float(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]))


def indicators(data: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Numbers as they are, strings as indicators of all states but the first; (frame, names of each column's parts)."""
    kinds = dict(data.dtypes)
    exprs, names = [], {}
    for c in columns:
        if kinds[c] == "string":
            levels = [r[0] for r in data.select(q(c)).filter(q(c).isNotNull()).distinct().orderBy(q(c)).collect()][1:]
            names[c] = [f"{c}={s}" for s in levels]
            exprs += [(q(c) == F.lit(s)).cast("double").alias(f"{c}={s}") for s in levels]
        else:
            names[c] = [c]
            exprs.append(q(c).cast("double").alias(c))
    return data.select(*exprs), names


@dataclass
class LinearGaussianCPD:
    """variable ~ N(intercept + slopes . parents, variance)."""

    variable: str
    intercept: float
    slopes: list[float]
    variance: float
    parents: list[str]

    @classmethod
    def fit(cls, gram: Gram, variable: str, parents: Sequence[str] = ()) -> LinearGaussianCPD:
        intercept, slopes, rss = gram.regress(variable, list(parents))
        return cls(variable, intercept, slopes.tolist(), rss / (gram.n - 1), list(parents))

    def mean(self) -> Column:
        out: Column = F.lit(self.intercept)
        for b, p in zip(self.slopes, self.parents, strict=True):
            out = out + F.lit(b) * q(p)
        return out

    def __str__(self) -> str:
        return f"P({self.variable}{' | ' if self.parents else ''}{', '.join(self.parents)}) = N({' + '.join([*(f'{b:g}*{p}' for b, p in zip(self.slopes, self.parents, strict=True)), f'{self.intercept:g}'])}; {self.variance:g})"


class GaussianDistribution:
    """A multivariate normal over named variables."""

    def __init__(self, variables: Sequence[str], mean: Sequence[float], cov: Sequence[Sequence[float]]):
        self.variables, self.mean, self.cov = list(variables), np.asarray(mean, float).ravel(), np.asarray(cov, float)
        if self.cov.shape != (len(self.variables),) * 2 or len(self.mean) != len(self.variables):
            raise ValueError("mean, covariance and variables differ in size")

    @property
    def precision(self) -> np.ndarray:
        return np.linalg.inv(self.cov)

    def _at(self, names: Iterable[str]) -> list[int]:
        return [self.variables.index(n) for n in names]

    def pdf(self, *x: float) -> float:
        d = np.asarray(x, float) - self.mean
        return float(np.exp(-0.5 * d @ self.precision @ d) / np.sqrt(np.linalg.det(2 * np.pi * self.cov)))

    def density(self) -> Column:
        """The density of rows with these columns."""
        p = self.precision
        d = [q(v) - F.lit(float(m)) for v, m in zip(self.variables, self.mean, strict=True)]
        form: Column = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                form = form + F.lit(float(p[i, j])) * d[i] * d[j]
        return F.exp(F.lit(-0.5) * form) / F.lit(float(np.sqrt(np.linalg.det(2 * np.pi * self.cov))))

    def marginalize(self, variables: Iterable[str]) -> GaussianDistribution:
        out = set(variables)
        keep = [v for v in self.variables if v not in out]
        at = self._at(keep)
        return GaussianDistribution(keep, self.mean[at], self.cov[np.ix_(at, at)])

    def reduce(self, values: dict[str, float]) -> GaussianDistribution:
        keep = [v for v in self.variables if v not in values]
        a, b = self._at(keep), self._at(values)
        gain = self.cov[np.ix_(a, b)] @ np.linalg.inv(self.cov[np.ix_(b, b)])
        return GaussianDistribution(keep, self.mean[a] + gain @ (np.array(list(values.values())) - self.mean[b]), self.cov[np.ix_(a, a)] - gain @ self.cov[np.ix_(b, a)])

    def to_canonical(self) -> CanonicalDistribution:
        k = self.precision
        h = k @ self.mean
        g = -0.5 * self.mean @ h - math.log(math.sqrt(np.linalg.det(2 * np.pi * self.cov)))
        return CanonicalDistribution(self.variables, k, h, float(g))

    def product(self, other: GaussianDistribution) -> GaussianDistribution:
        return self.to_canonical().product(other.to_canonical()).to_gaussian()

    def divide(self, other: GaussianDistribution) -> GaussianDistribution:
        return self.to_canonical().divide(other.to_canonical()).to_gaussian()

    def equals(self, other: GaussianDistribution, atol: float = 1e-8) -> bool:
        if set(self.variables) != set(other.variables):
            return False
        at = other._at(self.variables)
        return bool(np.allclose(self.mean, other.mean[at], atol=atol) and np.allclose(self.cov, other.cov[np.ix_(at, at)], atol=atol))


class CanonicalDistribution:
    """exp(-x'Kx / 2 + h'x + g)."""

    def __init__(self, variables: Sequence[str], k: np.ndarray, h: np.ndarray, g: float):
        self.variables, self.k, self.h, self.g = list(variables), np.asarray(k, float), np.asarray(h, float).ravel(), float(g)

    def _spread(self, variables: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = [variables.index(v) for v in self.variables]
        k, h = np.zeros((len(variables),) * 2), np.zeros(len(variables))
        k[np.ix_(at, at)], h[at] = self.k, self.h
        return k, h

    def _with(self, other: CanonicalDistribution, sign: int) -> CanonicalDistribution:
        names = self.variables + [v for v in other.variables if v not in self.variables]
        (k1, h1), (k2, h2) = self._spread(names), other._spread(names)
        return CanonicalDistribution(names, k1 + sign * k2, h1 + sign * h2, self.g + sign * other.g)

    def product(self, other: CanonicalDistribution) -> CanonicalDistribution:
        return self._with(other, 1)

    def divide(self, other: CanonicalDistribution) -> CanonicalDistribution:
        return self._with(other, -1)

    def pdf(self, *x: float) -> float:
        v = np.asarray(x, float)
        return float(np.exp(-0.5 * v @ self.k @ v + self.h @ v + self.g))

    def reduce(self, values: dict[str, float]) -> CanonicalDistribution:
        keep = [i for i, v in enumerate(self.variables) if v not in values]
        b = [self.variables.index(v) for v in values]
        y = np.array(list(values.values()), float)
        return CanonicalDistribution([self.variables[i] for i in keep], self.k[np.ix_(keep, keep)], self.h[keep] - self.k[np.ix_(keep, b)] @ y, self.g + self.h[b] @ y - 0.5 * y @ self.k[np.ix_(b, b)] @ y)

    def marginalize(self, variables: Iterable[str]) -> CanonicalDistribution:
        out = set(variables)
        i = [n for n, v in enumerate(self.variables) if v not in out]
        j = [n for n, v in enumerate(self.variables) if v in out]
        inv = np.linalg.inv(self.k[np.ix_(j, j)])
        kij = self.k[np.ix_(i, j)]
        g = self.g + 0.5 * (len(j) * math.log(2 * math.pi) + math.log(np.linalg.det(inv)) + self.h[j] @ inv @ self.h[j])
        return CanonicalDistribution([self.variables[n] for n in i], self.k[np.ix_(i, i)] - kij @ inv @ kij.T, self.h[i] - kij @ inv @ self.h[j], g)

    def to_gaussian(self) -> GaussianDistribution:
        cov = np.linalg.inv(self.k)
        return GaussianDistribution(self.variables, cov @ self.h, cov)


class LinearGaussianNetwork:
    def __init__(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = ()):
        self.dag = DAG(edges, nodes)
        self.cpds: dict[str, LinearGaussianCPD] = {}

    def fit(self, data: DataFrame) -> LinearGaussianNetwork:
        gram = Gram.of(data.select(*map(q, self.dag.nodes)))
        self.cpds = {v: LinearGaussianCPD.fit(gram, v, self.dag.parents(v)) for v in self.dag.nodes}
        return self

    def joint(self) -> GaussianDistribution:
        order = self.dag.topological()
        at = {v: i for i, v in enumerate(order)}
        b, omega, a = np.zeros((len(order),) * 2), np.zeros(len(order)), np.zeros(len(order))
        for v, c in self.cpds.items():
            a[at[v]], omega[at[v]] = c.intercept, c.variance
            for s, p in zip(c.slopes, c.parents, strict=True):
                b[at[v], at[p]] = s
        m = np.linalg.inv(np.eye(len(order)) - b)
        return GaussianDistribution(order, m @ a, m @ np.diag(omega) @ m.T)

    def predict(self, data: DataFrame) -> DataFrame:
        """``data`` with the conditional mean of each missing variable: an affine column expression."""
        joint = self.joint()
        given = [c for c in data.columns if c in self.dag.pa]
        missing = [v for v in joint.variables if v not in given]
        a, b = joint._at(missing), joint._at(given)
        gain = joint.cov[np.ix_(a, b)] @ np.linalg.inv(joint.cov[np.ix_(b, b)]) if given else np.zeros((len(a), 0))
        out = data
        for i, v in enumerate(missing):
            e: Column = F.lit(float(joint.mean[a[i]]))
            for j, g in enumerate(given):
                e = e + F.lit(float(gain[i, j])) * (q(g) - F.lit(float(joint.mean[b[j]])))
            out = out.withColumn(v, e)
        return out

    def simulate(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        out = spark.range(n).select(F.col("id").alias("_id"))
        for i, v in enumerate(self.dag.topological()):
            c = self.cpds[v]
            out = out.withColumn(v, c.mean() + F.lit(math.sqrt(c.variance)) * normal(F.col("_id"), seed + i))
        return out.select(*map(q, self.dag.nodes))

    @staticmethod
    def random(n: int = 5, edge_prob: float = 0.5, seed: int | None = None) -> LinearGaussianNetwork:
        dag = DAG.random(n, edge_prob, seed=seed)
        rng = np.random.default_rng(seed)
        out = LinearGaussianNetwork(dag.edges, dag.nodes)
        out.cpds = {v: LinearGaussianCPD(v, float(rng.normal()), rng.normal(size=len(dag.pa[v])).tolist(), float(abs(rng.normal())) + 0.1, dag.parents(v)) for v in dag.nodes}
        return out


def ate_linear(data: DataFrame, x: str, y: str, adjustment: Sequence[str] = ()) -> float:
    """The slope of x in the regression of y on x and the adjustment set."""
    return float(Gram.of(data.select(*map(q, [x, y, *adjustment]))).regress(y, [x, *adjustment])[1][0])


def two_stage_least_squares(data: DataFrame, x: str, y: str, instruments: Sequence[str], covariates: Sequence[str] = ()) -> float:
    """The effect of x on y by instruments, from one Gram matrix: x is replaced by its fit on instruments and covariates."""
    names = [y, x, *covariates, *instruments]
    c = Gram.of(data.select(*map(q, names))).cov(names)
    right = list(range(1, 2 + len(covariates)))
    z = list(range(2, len(names)))
    pinv = np.linalg.pinv(c[np.ix_(z, z)])
    a = c[np.ix_(right, z)] @ pinv @ c[np.ix_(z, right)]
    return float(np.linalg.solve(a, c[np.ix_(right, z)] @ pinv @ c[np.ix_(z, [0])])[0, 0])
