"""How well a model fits data or another model."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.functions.special import chi2_tail
from credalis.plans.graph import DAG, ordered


def shd(a: DAG, b: DAG) -> int:
    """Structural Hamming distance: pairs that differ; a reversed edge counts once."""
    if set(a.nodes) != set(b.nodes):
        raise ValueError("the graphs have other nodes")
    return len({frozenset(e) for e in set(a.edges) ^ set(b.edges)})


def shd_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(shd)`` of two edge tables (src, dst)."""
    odd = a.exceptAll(b).union(b.exceptAll(a))
    return odd.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().agg(F.count(F.lit(1)).alias("shd"))


def implied_cis(dag: DAG, tests) -> list[tuple[str, str, frozenset[str], float]]:
    """(u, v, separator, p) of every pair that isn't adjacent; all tests are counted together."""
    pairs = [(u, v, frozenset(dag.minimal_dseparator(u, v))) for u, v in itertools.combinations(dag.nodes, 2) if not dag.has_edge(u, v) and not dag.has_edge(v, u) and dag.minimal_dseparator(u, v) is not None]
    tests.prefetch(pairs)
    return [(u, v, z, tests.test(u, v, ordered(z))[1]) for u, v, z in pairs]


def fisher_c(dag: DAG, tests) -> float:
    """p of Fisher's C over the pairs that aren't adjacent, given the parents of both."""
    pairs = [(u, v, frozenset((dag.pa[u] | dag.pa[v]) - {u, v})) for u, v in itertools.combinations(dag.nodes, 2) if not dag.has_edge(u, v) and not dag.has_edge(v, u)]
    tests.prefetch(pairs)
    c = -2 * sum(math.log(max(tests.test(u, v, ordered(z))[1], 1e-6)) for u, v, z in pairs)
    return chi2_tail(c, 2 * len(pairs))


def f1(truth: Sequence[bool], found: Sequence[bool]) -> float:
    """Harmonic mean of precision and recall; 0 without any hit."""
    hit = sum(t and f for t, f in zip(truth, found, strict=True))
    return 2 * hit / (sum(truth) + sum(found)) if hit else 0.0


def correlation_score(dag: DAG, tests, level: float = 0.05, score: Callable[[Sequence[bool], Sequence[bool]], float] = f1, summary: bool = False) -> float | list[tuple[str, str, bool, bool]]:
    """How well d-separation in the graph predicts the tests' independence, over all pairs. The positive class is independence.

    ``score(truth, prediction)`` gets the tests' answers and the graph's. ``summary``: the rows ``(u, v, independent by the
    test, d-separated)`` instead.
    """
    pairs = list(itertools.combinations(dag.nodes, 2))
    tests.prefetch([(u, v, ()) for u, v in pairs])
    rows = [(u, v, bool(tests.independent(u, v, (), level)), not dag.is_dconnected(u, v)) for u, v in pairs]
    return rows if summary else score([r[2] for r in rows], [r[3] for r in rows])
