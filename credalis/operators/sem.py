"""Structural equation models: text syntax, implied covariance, estimation from one covariance matrix."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.functions.random import normal
from credalis.functions.special import chi2_tail
from credalis.operators.factors import q
from credalis.operators.gaussian import Gram
from credalis.plans.graph import DAG, ordered


class StructuralModel:
    """``paths``: (cause, effect) -> fixed coefficient or None for a free one; ``covariances``: pairs of variables whose errors
    are correlated. Latent variables are scaled by their first indicator."""

    def __init__(self, paths: dict[tuple[str, str], float | None], covariances: dict[tuple[str, str], float | None] | None = None, latents: Sequence[str] = ()):
        self.paths, self.covariances, self.latents = dict(paths), {tuple(sorted(k)): v for k, v in (covariances or {}).items()}, set(latents)
        self.variables = ordered({v for e in (*paths, *self.covariances) for v in e})
        self.observed = [v for v in self.variables if v not in self.latents]

    @classmethod
    def parse(cls, text: str) -> StructuralModel:
        """Lines ``y ~ x1 + 0.5*x2`` (regression), ``f =~ y1 + y2`` (indicators), ``a ~~ b`` (covariance), ``y ~ 1`` or ``~1`` (intercept, implied)."""
        paths: dict[tuple[str, str], float | None] = {}
        cov: dict[tuple[str, str], float | None] = {}
        latents: list[str] = []
        for line in re.split(r"[\n;]", re.sub(r"#.*", "", text)):
            if not line.strip():
                continue
            m = re.fullmatch(r"\s*([\w.+\s]+?)\s*(=~|~~|~)\s*(.+?)\s*", line)
            if not m:
                raise ValueError(f"can't read {line.strip()!r}")
            for left in re.split(r"\s*\+\s*", m[1]):
                for term in re.split(r"\s*\+\s*", m[3]):
                    fixed, _, name = term.rpartition("*")
                    value = float(fixed) if re.fullmatch(r"\s*-?[\d.]+\s*", fixed) else None
                    name = name.strip()
                    if m[2] == "=~":
                        latents.append(left)
                        paths[left, name] = value
                    elif m[2] == "~~":
                        cov[left, name] = value
                    elif name != "1":
                        paths[name, left] = value
        out = cls(paths, cov, latents)
        out.scale()
        return out

    def scale(self) -> None:
        """Fixes the first path from each latent variable to an observed one at 1, unless one is fixed."""
        for f in ordered(self.latents):
            own = [e for e in self.paths if e[0] == f and e[1] not in self.latents]
            if own and not any(self.paths[e] is not None for e in own):
                self.paths[own[0]] = 1.0

    @property
    def dag(self) -> DAG:
        return DAG(list(self.paths), self.variables, self.latents)

    def parameters(self) -> list[tuple[str, str, str]]:
        """The free ones: ("path", cause, effect), ("cov", a, b), variances among them."""
        out = [("path", *e) for e, v in self.paths.items() if v is None]
        out += [("cov", *e) for e, v in self.covariances.items() if v is None and e[0] != e[1]]
        return out + [("cov", v, v) for v in self.variables if self.covariances.get((v, v)) is None]

    def matrices(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, error covariance) over all variables, in the reticular action form."""
        at = {v: i for i, v in enumerate(self.variables)}
        b, omega = np.zeros((len(at),) * 2), np.zeros((len(at),) * 2)
        for (u, v), x in self.paths.items():
            b[at[v], at[u]] = x or 0.0
        for (u, v), x in self.covariances.items():
            omega[at[u], at[v]] = omega[at[v], at[u]] = x or 0.0
        for (kind, u, v), x in zip(self.parameters(), theta, strict=True):
            if kind == "path":
                b[at[v], at[u]] = x
            else:
                omega[at[u], at[v]] = omega[at[v], at[u]] = x
        return b, omega

    def implied(self, theta: np.ndarray, names: Sequence[str] | None = None) -> np.ndarray:
        b, omega = self.matrices(theta)
        m = np.linalg.inv(np.eye(len(b)) - b)
        at = [self.variables.index(v) for v in (names or self.observed)]
        return (m @ omega @ m.T)[np.ix_(at, at)]

    def lisrel(self, theta: np.ndarray) -> dict[str, np.ndarray | list[str]]:
        """Measurement and structural blocks: loadings of observed on latent variables, paths among the latent, errors."""
        b, omega = self.matrices(theta)
        lat = [self.variables.index(v) for v in ordered(self.latents)]
        obs = [self.variables.index(v) for v in self.observed]
        return {"lambda": b[np.ix_(obs, lat)], "beta": b[np.ix_(lat, lat)], "psi": omega[np.ix_(lat, lat)], "theta": omega[np.ix_(obs, obs)], "latents": ordered(self.latents), "observed": self.observed}

    def simulate(self, spark: SparkSession, theta: np.ndarray, n: int, seed: int = 0) -> DataFrame:
        chol = np.linalg.cholesky(self.implied(theta) + 1e-12 * np.eye(len(self.observed)))
        base = spark.range(n).select("id", *[normal(F.col("id"), seed + i).alias(f"_z{i}") for i in range(len(chol))])
        total = lambda row: sum((F.lit(float(c)) * F.col(f"_z{j}") for j, c in enumerate(row) if c), F.lit(0.0))
        return base.select(*[total(chol[i]).alias(v) for i, v in enumerate(self.observed)])


class SemEstimator:
    """Fits the free parameters to the covariance matrix that Spark aggregates once. ``method``: ML, ULS or GLS."""

    def __init__(self, model: StructuralModel, method: str = "ML"):
        self.model, self.method = model, method.upper()

    def loss(self, theta: np.ndarray, s: np.ndarray) -> float:
        try:
            sigma = self.model.implied(theta)
        except np.linalg.LinAlgError:
            return math.inf
        if self.method == "ULS":
            return 0.5 * float(((s - sigma) ** 2).sum())
        if self.method == "GLS":
            d = np.eye(len(s)) - sigma @ np.linalg.inv(s)
            return 0.5 * float(np.trace(d @ d))
        sign, log = np.linalg.slogdet(sigma)
        if sign <= 0 or np.linalg.eigvalsh(sigma)[0] <= 0:
            return math.inf
        return float(log + np.trace(s @ np.linalg.inv(sigma)) - np.linalg.slogdet(s)[1] - len(s))

    def fit(self, data: DataFrame, rounds: int = 500, tolerance: float = 1e-10) -> tuple[dict[tuple[str, str, str], float], dict[str, float]]:
        """(parameters, statistics): quasi-Newton with numerical gradients and backtracking."""
        names = self.model.observed
        gram = Gram.of(data.select(*map(q, names)))
        s = gram.cov(names)
        free = self.model.parameters()
        var = dict(zip(names, np.diag(s), strict=True))
        x = np.array([0.5 if k == "path" else 0.5 * var.get(u, float(np.mean(np.diag(s)))) if u == v else 0.0 for k, u, v in free])
        f = lambda t: self.loss(t, s)

        def gradient(t: np.ndarray) -> np.ndarray:
            out = np.zeros(len(t))
            for i in range(len(t)):
                h = 1e-6 * max(1.0, abs(t[i]))
                d = np.zeros(len(t))
                d[i] = h
                out[i] = (f(t + d) - f(t - d)) / (2 * h)
            return np.nan_to_num(out, posinf=0, neginf=0)

        inverse, g, now = np.eye(len(x)), gradient(x), f(x)
        for _ in range(rounds):
            step = -inverse @ g
            if step @ g > 0:
                inverse, step = np.eye(len(x)), -g
            a = 1.0
            while f(x + a * step) > now + 1e-4 * a * (step @ g) and a > 1e-12:
                a /= 2
            y = x + a * step
            if not f(y) < now:
                break
            gy = gradient(y)
            d, e = y - x, gy - g
            if (r := d @ e) > 1e-14:
                i = np.eye(len(x))
                inverse = (i - np.outer(d, e) / r) @ inverse @ (i - np.outer(e, d) / r) + np.outer(d, d) / r
            done = now - f(y) < tolerance
            x, g, now = y, gy, f(y)
            if done:
                break
        dof = len(s) * (len(s) + 1) // 2 - len(free)
        chi = (gram.n - 1) * now
        stats = {"loss": now, "chi2": chi, "dof": dof, "p": chi2_tail(chi, dof), "rmsea": math.sqrt(max(0.0, (chi / dof - 1) / (gram.n - 1))) if dof > 0 else 0.0, "srmr": float(np.sqrt(np.mean(((s - self.model.implied(x)) / np.sqrt(np.outer(np.diag(s), np.diag(s)))) ** 2)))}
        return dict(zip(free, x.tolist(), strict=True)), stats
