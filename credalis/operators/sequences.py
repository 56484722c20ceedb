"""Sequences: transitions, Markov chains and dynamic networks over long data, ordered by window functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credalis.operators.factors import CPD, VALUE, Factor, q
from credalis.operators.network import BayesianNetwork, mle_cpd


def slice_pairs(data: DataFrame, key: str, order: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """``(v_0, v_1)`` for each variable: each row of a sequence with the next one."""
    w = Window.partitionBy(q(key)).orderBy(*map(q, order))
    both = data.select(*[q(v).alias(f"{v}_0") for v in variables], *[F.lead(q(v)).over(w).alias(f"{v}_1") for v in variables], F.lead(F.lit(1)).over(w).alias("_next"))
    return both.filter("_next is not null").drop("_next")


def transition_matrix(data: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """``(state, next, p)``."""
    pairs = slice_pairs(data, key, order, [state]).groupBy(q(f"{state}_0").alias("state"), q(f"{state}_1").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("state", "next", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


def block_counts(data: DataFrame, key: str, order: Sequence[str], state: str, size: int) -> DataFrame:
    """``(key, block, state, n)``: counts of states in consecutive blocks of ``size`` rows of each sequence."""
    w = Window.partitionBy(q(key)).orderBy(*map(q, order))
    rows = data.select(q(key), q(state).alias("state"), F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("block"))
    return rows.groupBy(q(key), "block", "state").agg(F.count(F.lit(1)).alias("n"))


class MarkovChain:
    """A chain over one or more variables, each with its own transition matrix."""

    def __init__(self, transitions: dict[str, np.ndarray], states: dict[str, list] | None = None):
        self.transitions = {v: np.asarray(m, float) for v, m in transitions.items()}
        self.states = states or {v: list(range(len(m))) for v, m in self.transitions.items()}
        for v, m in self.transitions.items():
            if m.shape != (len(self.states[v]),) * 2 or not np.allclose(m.sum(1), 1):
                raise ValueError(f"the rows of {v} don't sum to 1")

    @classmethod
    def fit(cls, data: DataFrame, key: str, order: Sequence[str], state: str) -> MarkovChain:
        rows = transition_matrix(data, key, order, state).collect()
        names = sorted({r.state for r in rows} | {r.next for r in rows})
        m = np.zeros((len(names),) * 2)
        for r in rows:
            m[names.index(r.state), names.index(r.next)] = r.p
        m[m.sum(1) == 0] = 1 / len(names)
        return cls({state: m}, {state: names})

    def stationary(self, variable: str) -> np.ndarray:
        """The left eigenvector of the eigenvalue 1."""
        values, vectors = np.linalg.eig(self.transitions[variable].T)
        v = np.real(vectors[:, np.argmin(np.abs(values - 1))])
        return v / v.sum()

    def is_stationary(self, variable: str, sample: Sequence[float], tolerance: float = 0.2) -> bool:
        return bool(np.all(np.abs(self.stationary(variable) - np.asarray(sample)) <= tolerance))

    def sample(self, spark: SparkSession, steps: int, chains: int = 1, start: dict[str, object] | None = None, seed: int = 0) -> DataFrame:
        """``(chain, step, variables...)``: independent chains run side by side, one row each in a task."""
        transitions, states = self.transitions, self.states
        names = list(transitions)
        kinds = {v: "string" if isinstance(states[v][0], str) else "long" for v in names}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chain in b.column(0).to_pylist():
                    rng = np.random.default_rng((seed, chain))
                    cols = {}
                    for v in names:
                        cum = transitions[v].cumsum(1)
                        at = states[v].index(start[v]) if start else int(rng.integers(len(states[v])))
                        path = [at]
                        for u in rng.random(steps - 1):
                            at = min(int(np.searchsorted(cum[at], u, "right")), len(states[v]) - 1)
                            path.append(at)
                        cols[v] = [states[v][k] for k in path]
                    yield pa.record_batch([pa.array([chain] * steps, pa.int64()), pa.array(range(steps), pa.int64()), *(pa.array(cols[v], pa.string() if kinds[v] == "string" else pa.int64()) for v in names)], ["chain", "step", *names])

        return spark.range(chains).mapInArrow(run, "chain long, step long, " + ", ".join(f"`{v}` {kinds[v]}" for v in names))

    def probability(self, sample: DataFrame, target: dict[str, object], block: int = 100) -> DataFrame:
        """``(chain, block, p)``: the share of steps in the target state, in consecutive blocks."""
        hit = F.lit(True)
        for v, s in target.items():
            hit = hit & (q(v) == F.lit(s))
        return sample.groupBy("chain", F.floor(F.col("step") / block).alias("block")).agg(F.avg(hit.cast("double")).alias("p"))


class DynamicNetwork:
    """A two-slice network: ``intra`` edges within a slice, ``inter`` edges from a slice to the next. Variable v of slice t is ``v_t``."""

    def __init__(self, intra: Sequence[tuple[str, str]], inter: Sequence[tuple[str, str]]):
        self.intra, self.inter = list(intra), list(inter)
        self.variables = sorted({v for e in (*intra, *inter) for v in e})
        self.first: dict[str, CPD] = {}
        self.later: dict[str, CPD] = {}

    def slice_parents(self, v: str, t: int) -> list[str]:
        own = [f"{u}_{min(t, 1)}" for u, w in self.intra if w == v]
        return sorted(own + ([f"{u}_0" for u, w in self.inter if w == v] if t else []))

    @property
    def interface(self) -> list[str]:
        return sorted({u for u, _ in self.inter})

    def set_tables(self, first: Sequence[CPD], later: Sequence[CPD] = ()) -> DynamicNetwork:
        """Tables of slice 0 (``v_0``) and slice 1 (``v_1``). Those of slice 1 that are left out are the ones of slice 0, where the parents allow."""
        self.first = {c.variable[:-2]: c for c in first}
        self.later = {c.variable[:-2]: c for c in later}
        for v, c in self.first.items():
            if v not in self.later:
                names = {n: f"{n[:-2]}_1" for n in c.variables}
                df = c.df.select(*[q(n).alias(m) for n, m in names.items()], VALUE)
                self.later[v] = CPD(df, names[c.variable], [names[p] for p in c.parents], {names[n]: s for n, s in c.states.items()})
        return self

    def fit(self, data: DataFrame, key: str, order: Sequence[str]) -> DynamicNetwork:
        """From long data: slice 0 from the first rows, transitions from all pairs of neighbours."""
        w = Window.partitionBy(q(key)).orderBy(*map(q, order))
        start = data.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*[q(v).alias(f"{v}_0") for v in self.variables])
        pairs = slice_pairs(data, key, order, self.variables)
        self.first = {v: mle_cpd(start, f"{v}_0", self.slice_parents(v, 0)) for v in self.variables}
        self.later = {v: mle_cpd(pairs, f"{v}_1", self.slice_parents(v, 1)) for v in self.variables}
        return self

    def unrolled(self, slices: int) -> BayesianNetwork:
        """The network of that many slices."""
        net = BayesianNetwork(nodes=[f"{v}_{t}" for t in range(slices) for v in self.variables])
        for t in range(slices):
            for v in self.variables:
                c = (self.later if t else self.first)[v]
                names = {n: f"{n.rsplit('_', 1)[0]}_{t - 1 + int(n.rsplit('_', 1)[1]) if t else 0}" for n in c.variables}
                for p in c.parents:
                    net.dag.add_edge(names[p], names[c.variable])
                df = c.df.select(*[q(n).alias(m) for n, m in names.items()], VALUE)
                net.add_cpds(CPD(df, names[c.variable], [names[p] for p in c.parents], {names[n]: s for n, s in c.states.items()}))
        return net

    def query(self, variables: Sequence[str], evidence: dict[str, object] | None = None) -> dict[str, Factor]:
        """The posterior of each variable ``v_t`` given all evidence: earlier and later slices alike."""
        last = max(int(n.rsplit("_", 1)[1]) for n in (*variables, *(evidence or {})))
        net = self.unrolled(last + 1)
        return {v: net.query([v], evidence) for v in variables}

    def forward(self, variables: Sequence[str], evidence: dict[str, object] | None = None) -> dict[str, Factor]:
        """Filtering: each ``v_t`` given the evidence up to its own slice."""
        out = {}
        for v in variables:
            t = int(v.rsplit("_", 1)[1])
            seen = {e: s for e, s in (evidence or {}).items() if int(e.rsplit("_", 1)[1]) <= t}
            out[v] = self.query([v], seen)[v]
        return out

    def simulate(self, n: int, slices: int, seed: int = 0) -> DataFrame:
        return self.unrolled(slices).sample(n, seed)
