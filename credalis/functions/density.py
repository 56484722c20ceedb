"""Continuous factors given by a density: algebra, numerical integrals, and discretisation, on the driver."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_X, _W = np.polynomial.legendre.leggauss(60)


def integrate(f: Callable[[float], float], lo: float = -math.inf, hi: float = math.inf, parts: int = 24) -> float:
    """Gauss-Legendre in pieces; infinite ends are mapped by x = t / (1 - t**2)."""
    if math.isinf(lo) or math.isinf(hi):
        a = -1.0 if math.isinf(lo) else (math.sqrt(1 + 4 * lo * lo) - 1) / (2 * lo) if lo else 0.0
        b = 1.0 if math.isinf(hi) else (math.sqrt(1 + 4 * hi * hi) - 1) / (2 * hi) if hi else 0.0
        return integrate(lambda t: f(t / (1 - t * t)) * (1 + t * t) / (1 - t * t) ** 2, a + (1e-9 if a == -1 else 0), b - (1e-9 if b == 1 else 0), parts)
    edges = np.linspace(lo, hi, parts + 1)
    return float(sum(w * h / 2 * f(m + h / 2 * x) for m, h in zip((edges[1:] + edges[:-1]) / 2, np.diff(edges), strict=True) for x, w in zip(_X, _W, strict=True)))


def density_column(pdf: Callable[..., float], *columns: Column, vectorized: bool = False) -> Column:
    """A density of the caller's, evaluated on the rows: ``pdf`` of each row's values, or of whole arrays if ``vectorized``. A null gives a null."""

    def of(*values: pa.Array) -> pa.Array:
        known = functools.reduce(np.logical_and, [v.is_valid().to_numpy(zero_copy_only=False) for v in values])
        rows = [v.fill_null(0.0).to_numpy(zero_copy_only=False)[known] for v in values]
        out = np.zeros(len(known))
        out[known] = np.asarray(pdf(*rows), float) if vectorized else [float(pdf(*x)) for x in zip(*rows, strict=True)]
        return pa.array(out, pa.float64(), mask=~known)

    return F.arrow_udf(of, "double")(*[c.cast("double") for c in columns])


class ContinuousFactor:
    """``pdf`` takes the variables in order."""

    def __init__(self, variables: Sequence[str], pdf: Callable[..., float]):
        self.variables, self.pdf = list(variables), pdf

    def assignment(self, *x: float) -> float:
        return self.pdf(*x)

    def _with(self, other: ContinuousFactor, how: Callable[[float, float], float]) -> ContinuousFactor:
        names = self.variables + [v for v in other.variables if v not in self.variables]
        a, b = [names.index(v) for v in self.variables], [names.index(v) for v in other.variables]
        f, g = self.pdf, other.pdf
        return ContinuousFactor(names, lambda *x: how(f(*(x[i] for i in a)), g(*(x[i] for i in b))))

    def product(self, other: ContinuousFactor) -> ContinuousFactor:
        return self._with(other, lambda x, y: x * y)

    def divide(self, other: ContinuousFactor) -> ContinuousFactor:
        return self._with(other, lambda x, y: 0.0 if x == 0 else x / y if y else math.inf)

    def reduce(self, values: dict[str, float]) -> ContinuousFactor:
        names, f = self.variables, self.pdf
        keep = [v for v in names if v not in values]
        return ContinuousFactor(keep, lambda *x: f(*(values[v] if v in values else x[keep.index(v)] for v in names)))

    def marginalize(self, variables: Sequence[str]) -> ContinuousFactor:
        out = self
        for v in variables:
            i, f = out.variables.index(v), out.pdf
            out = ContinuousFactor(out.variables[:i] + out.variables[i + 1 :], lambda *x, i=i, f=f: integrate(lambda t: f(*x[:i], t, *x[i:])))
        return out

    def normalize(self) -> ContinuousFactor:
        total = self.marginalize(self.variables).pdf()
        f = self.pdf
        return ContinuousFactor(self.variables, lambda *x: f(*x) / total)

    def is_valid(self) -> bool:
        return abs(self.marginalize(self.variables).pdf() - 1) < 1e-3

    def cdf(self, x: float) -> float:
        return integrate(self.pdf, hi=x)


def rounding(cdf: Callable[[float], float], lo: float, hi: float, cardinality: int) -> list[float]:
    """Mass of half steps around equally spaced points; the ends take what lies between them and their neighbours' half."""
    step = (hi - lo) / cardinality
    points = [lo + step * k for k in range(cardinality)]
    first = cdf(lo + step / 2) - cdf(lo)
    return [first] + [cdf(x + step / 2) - cdf(x - step / 2) for x in points[1:]]


def unbiased(pdf: Callable[[float], float], cdf: Callable[[float], float], lo: float, hi: float, cardinality: int) -> list[float]:
    """Masses that keep the limited expected value at each point."""
    step = (hi - lo) / (cardinality - 1)

    def limited(u: float) -> float:
        return integrate(lambda x: x * pdf(x), hi=u) + u * (1 - cdf(u))

    xs = [lo + step * k for k in range(cardinality)]
    e = [limited(x) for x in (xs[0], *xs[1:])]
    first = (e[0] - e[1]) / step + 1 - cdf(lo)
    middle = [(2 * e[k] - e[k - 1] - e[k + 1]) / step for k in range(1, cardinality - 1)]
    return [first, *middle, (e[-1] - e[-2]) / step - 1 + cdf(hi)]


def labels(lo: float, step: float, cardinality: int) -> list[str]:
    return [f"x={lo + step * k:g}" for k in range(cardinality)]
