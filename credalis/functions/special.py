"""Special functions: ln Gamma as a column expression, and tails of distributions on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def lgamma(x: Column) -> Column:
    """ln Gamma of a positive column: moved to 8 or more by the recurrence, then Stirling's series (relative error below 1e-14)."""
    x = x.cast("double")
    shift = F.when(x < 8, F.lit(8.0) - F.floor(x)).otherwise(F.lit(0.0))
    product = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1.0), lambda acc, i: acc * F.when(i < shift, x + i).otherwise(F.lit(1.0)))
    y = x + shift
    series = F.lit(0.0)
    power = F.lit(1.0) / y
    for c in _STIRLING:
        series = series + F.lit(c) * power
        power = power / (y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-squared with ``dof`` degrees of freedom >= x); 1 without degrees of freedom."""
    return 1.0 if dof <= 0 else gamma_q(dof / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a * h


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_tail(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
