"""Markov chain Monte Carlo: many independent chains, each a row that a task works through with numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from credalis.operators.factors import Factor

Density = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _chains(spark: SparkSession, chains: int, names: Sequence[str], kind: str, walk: Callable[[int], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chain in b.column(0).to_pylist():
                rows = walk(chain)
                yield pa.record_batch([pa.array([chain] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *(pa.array(rows[:, i].tolist(), pa.float64() if kind == "double" else pa.int64()) for i in range(len(names)))], ["chain", "step", *names])

    return spark.range(chains).repartition(max(1, min(chains, spark.sparkContext.defaultParallelism))).mapInArrow(run, "chain long, step long, " + ", ".join(f"`{n}` {kind}" for n in names))


def gibbs(spark: SparkSession, factors: Sequence[Factor], size: int, chains: int = 1, burn: int = 100, seed: int = 0, start: dict[str, int] | None = None) -> DataFrame:
    """``(chain, step, variables...)`` with state numbers: each variable in turn is drawn given all others."""
    names = sorted({v for f in factors for v in f.variables})
    cards = {v: len(f.states[v]) for f in factors for v in f.variables}
    tables = [(f.variables, np.log(np.maximum(f.values(), 1e-300))) for f in factors]
    touching = {v: [(s, t) for s, t in tables if v in s] for v in names}

    def walk(chain: int) -> np.ndarray:
        rng = np.random.default_rng((seed, chain))
        at = {v: (start or {}).get(v, int(rng.integers(cards[v]))) for v in names}
        out = np.zeros((size, len(names)), np.int64)
        for step in range(-burn, size):
            for v in names:
                log = np.zeros(cards[v])
                for scope, t in touching[v]:
                    log = log + t[tuple(slice(None) if u == v else at[u] for u in scope)]
                p = np.exp(log - log.max()).cumsum()
                at[v] = min(int(np.searchsorted(p, rng.random() * p[-1], "right")), cards[v] - 1)
            if step >= 0:
                out[step] = [at[v] for v in names]
        return out

    return _chains(spark, chains, names, "long", walk)


def gaussian_density(mean: Sequence[float], cov: Sequence[Sequence[float]]) -> Density:
    """Log density and its gradient of a multivariate normal."""
    m, k = np.asarray(mean, float), np.linalg.inv(np.asarray(cov, float))

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        g = -k @ (x - m)
        return 0.5 * float((x - m) @ g), g

    return f


def leapfrog(f: Density, x: np.ndarray, r: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    r = r + step / 2 * f(x)[1]
    x = x + step * r
    return x, r + step / 2 * f(x)[1]


def modified_euler(f: Density, x: np.ndarray, r: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    r = r + step * f(x)[1]
    return x + step * r, r


def _joint(f: Density, x: np.ndarray, r: np.ndarray) -> float:
    return f(x)[0] - 0.5 * float(r @ r)


def first_step(f: Density, x: np.ndarray, rng: np.random.Generator, move=leapfrog) -> float:
    """A step whose acceptance is about one half."""
    step, r = 1.0, rng.standard_normal(len(x))
    start = _joint(f, x, r)
    up = _joint(f, *move(f, x, r, step)) - start > math.log(0.5)
    while (_joint(f, *move(f, x, r, step)) - start > math.log(0.5)) == up and 1e-7 < step < 1e7:
        step *= 2 if up else 0.5
    return step


class DualAveraging:
    """Step sizes that lead to a target acceptance; shrinkage 0.05, offset 10, decay 0.75."""

    def __init__(self, step: float, target: float = 0.65):
        self.mu, self.target, self.bar, self.mean, self.t = math.log(10 * step), target, 0.0, 0.0, 0

    def update(self, acceptance: float) -> float:
        self.t += 1
        self.mean += (self.target - acceptance - self.mean) / (self.t + 10)
        log = self.mu - math.sqrt(self.t) / 0.05 * self.mean
        w = self.t**-0.75
        self.bar = w * log + (1 - w) * self.bar
        return math.exp(log)

    @property
    def final(self) -> float:
        return math.exp(self.bar)


def hmc(spark: SparkSession, f: Density, names: Sequence[str], size: int, chains: int = 1, start: Sequence[float] | None = None, length: float = 2.0, step: float | None = None, adapt: int = 0, seed: int = 0, move=leapfrog) -> DataFrame:
    """Hamiltonian Monte Carlo with trajectories of a fixed length; ``adapt`` steps tune the step size first and are left out."""

    def walk(chain: int) -> np.ndarray:
        rng = np.random.default_rng((seed, chain))
        x = np.array(start if start is not None else rng.standard_normal(len(names)), float)
        eps = step or first_step(f, x, rng, move)
        tune, out = DualAveraging(eps), np.zeros((size, len(names)))
        for i in range(-adapt, size):
            r = rng.standard_normal(len(x))
            y, s = x, r
            for _ in range(max(1, min(1000, round(length / eps)))):
                y, s = move(f, y, s, eps)
            accept = math.exp(min(0.0, _joint(f, y, s) - _joint(f, x, r)))
            if rng.random() < accept:
                x = y
            if i < 0:
                eps = tune.update(accept)
                if i == -1:
                    eps = tune.final
            else:
                out[i] = x
        return out

    return _chains(spark, chains, names, "double", walk)


def nuts(spark: SparkSession, f: Density, names: Sequence[str], size: int, chains: int = 1, start: Sequence[float] | None = None, step: float | None = None, adapt: int = 0, seed: int = 0, depth: int = 10) -> DataFrame:
    """The no-U-turn sampler: trajectories double until they turn back."""

    def walk(chain: int) -> np.ndarray:
        rng = np.random.default_rng((seed, chain))
        x = np.array(start if start is not None else rng.standard_normal(len(names)), float)
        eps = step or first_step(f, x, rng)
        tune, out = DualAveraging(eps), np.zeros((size, len(names)))

        def tree(x, r, u, v, j, base):
            if j == 0:
                y, s = leapfrog(f, x, r, v * eps)
                h = _joint(f, y, s)
                return y, s, y, s, y, int(u <= h), u < h + 1000, min(1.0, math.exp(min(0.0, h - base))), 1
            xm, rm, xp, rp, y, n, ok, a, na = tree(x, r, u, v, j - 1, base)
            if ok:
                if v < 0:
                    xm, rm, _, _, y2, n2, ok2, a2, na2 = tree(xm, rm, u, v, j - 1, base)
                else:
                    _, _, xp, rp, y2, n2, ok2, a2, na2 = tree(xp, rp, u, v, j - 1, base)
                if n2 and rng.random() < n2 / max(1, n + n2):
                    y = y2
                a, na = a + a2, na + na2
                ok = ok2 and (xp - xm) @ rm >= 0 and (xp - xm) @ rp >= 0
                n += n2
            return xm, rm, xp, rp, y, n, ok, a, na

        for i in range(-adapt, size):
            r = rng.standard_normal(len(x))
            base = _joint(f, x, r)
            u = base + math.log(max(rng.random(), 1e-300))
            xm = xp = x
            rm = rp = r
            n, ok, a, na = 1, True, 0.0, 1
            for j in range(depth):
                v = 1 if rng.random() < 0.5 else -1
                if v < 0:
                    xm, rm, _, _, y, n2, ok2, a, na = tree(xm, rm, u, v, j, base)
                else:
                    _, _, xp, rp, y, n2, ok2, a, na = tree(xp, rp, u, v, j, base)
                if ok2 and n2 and rng.random() < n2 / n:
                    x = y
                n += n2
                ok = ok2 and (xp - xm) @ rm >= 0 and (xp - xm) @ rp >= 0
                if not ok:
                    break
            if i < 0:
                eps = tune.update(a / na)
                if i == -1:
                    eps = tune.final
            else:
                out[i] = x
        return out

    return _chains(spark, chains, names, "double", walk)
