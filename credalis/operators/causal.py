"""Causal queries: adjustment sets on the graph, interventional distributions and effects on data."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.operators.factors import Factor, q
from credalis.operators.gaussian import ate_linear
from credalis.operators.network import BayesianNetwork
from credalis.plans.graph import DAG, ordered


def _paths(dag: DAG, x: str, y: str) -> Iterator[list[str]]:
    todo = [[x]]
    while todo:
        p = todo.pop()
        if p[-1] == y:
            yield p
        else:
            todo += [[*p, c] for c in dag.children(p[-1])]


def is_valid_backdoor(dag: DAG, x: str, y: str, z: Iterable[str] = ()) -> bool:
    """Whether z blocks every path into x that leads to y."""
    z = set(z)
    return all(not dag.is_dconnected(p, y, {x} | z) for p in dag.pa[x] - z)


def backdoor_sets(dag: DAG, x: str, y: str) -> list[frozenset[str]]:
    """The inclusion-minimal sets of observed non-descendants of x; empty if nothing needs adjustment."""
    if is_valid_backdoor(dag, x, y):
        return []
    pool = ordered(set(dag.nodes) - {x, y} - dag.descendants([x]) - dag.latents)
    out: list[frozenset[str]] = []
    for k in range(1, len(pool) + 1):
        for s in map(frozenset, itertools.combinations(pool, k)):
            if not any(o <= s for o in out) and is_valid_backdoor(dag, x, y, s):
                out.append(s)
    return out


def is_valid_frontdoor(dag: DAG, x: str, y: str, z: Iterable[str]) -> bool:
    z = set(z)
    if not all(z & set(p) for p in _paths(dag, x, y)):
        return False
    return all(is_valid_backdoor(dag, x, m) for m in z) and all(is_valid_backdoor(dag, m, y, {x} | (z - {m})) for m in z)


def frontdoor_sets(dag: DAG, x: str, y: str) -> list[frozenset[str]]:
    pool = ordered(set(dag.nodes) - {x, y} - dag.latents)
    return [s for k in range(1, len(pool) + 1) for s in map(frozenset, itertools.combinations(pool, k)) if is_valid_frontdoor(dag, x, y, s)]


def proper_backdoor_graph(dag: DAG, xs: Iterable[str], ys: Iterable[str]) -> DAG:
    """Without the first edges of the causal paths that leave xs."""
    xs, ys = set(xs), set(ys)
    out = dag.copy()
    clear = dag.copy()
    for x in xs:
        for p in dag.parents(x):
            clear.remove_edge(p, x)
    for x in xs:
        for c in dag.children(x):
            if c not in xs and clear.descendants([c]) & ys:
                out.remove_edge(x, c)
    return out


def is_valid_adjustment_set(dag: DAG, xs: Sequence[str], ys: Sequence[str], z: Iterable[str]) -> bool:
    g, z = proper_backdoor_graph(dag, xs, ys), set(z)
    return all(not g.is_dconnected(x, y, z) for x in xs for y in ys)


def minimal_adjustment_set(dag: DAG, x: str, y: str) -> set[str] | None:
    return proper_backdoor_graph(dag, [x], [y]).minimal_dseparator(x, y)


def do_query(net: BayesianNetwork, variables: Sequence[str], do: dict[str, object], evidence: dict[str, object] | None = None, adjustment: Iterable[str] | None = None) -> Factor:
    """P(variables | do) = sum over z of P(variables | do, z, e) P(z | e): one join and one grouped sum.

    The adjustment set defaults to the parents of the intervened variables.
    """
    evidence = evidence or {}
    z = [n for n in (ordered(set().union(*(net.dag.pa[v] for v in do))) if adjustment is None else list(adjustment)) if n not in do and n not in evidence]
    if hidden := set(z) & net.dag.latents:
        raise ValueError(f"latent variables can't be adjusted for: {sorted(hidden)}")
    if not z:
        return net.query(variables, {**do, **evidence})
    inner = net.query([*variables, *z], {**do, **evidence})
    given = inner.marginalize(variables)
    weight = net.query(z, evidence) if evidence else net.query(z)
    return inner.divide(given).product(weight).marginalize(z).normalize()


def adjusted(data: DataFrame, x: str, y: str, z: Sequence[str]) -> DataFrame:
    """``(x, y, p)``: P(y | do(x)) from data by the backdoor formula, in one plan. Rows with a null in x, y or z don't count."""
    z = list(z)
    data = data.dropna(subset=[x, y, *z])
    n = F.count(F.lit(1)).cast("double")
    xyz = data.groupBy(q(x), q(y), *map(q, z)).agg(n.alias("nxyz"))
    xz = data.groupBy(q(x), *map(q, z)).agg(n.alias("nxz"))
    nz = data.groupBy(*map(q, z)).agg(n.alias("nz"))
    total = data.agg(n.alias("t"))
    joined = xyz.join(xz, [x, *z]).join(nz, z).crossJoin(total)
    return joined.groupBy(q(x), q(y)).agg(F.sum(F.col("nxyz") / F.col("nxz") * F.col("nz") / F.col("t")).alias("p"))


def frontdoor_adjusted(data: DataFrame, x: str, m: str, y: str) -> DataFrame:
    """``(x, y, p)``: sum over m of P(m | x) sum over x' of P(y | x', m) P(x'). Rows with a null in x, m or y don't count."""
    data = data.dropna(subset=[x, m, y])
    n = F.count(F.lit(1)).cast("double")
    nx = data.groupBy(q(x)).agg(n.alias("nx"))
    nxm = data.groupBy(q(x), q(m)).agg(n.alias("nxm"))
    nxmy = data.groupBy(q(x), q(m), q(y)).agg(n.alias("nxmy"))
    total = data.agg(n.alias("t"))
    inner = nxmy.join(nxm, [x, m]).join(nx, x).crossJoin(total).groupBy(q(m), q(y)).agg(F.sum(F.col("nxmy") / F.col("nxm") * F.col("nx") / F.col("t")).alias("pi"))
    return nxm.join(nx, x).join(inner, m).groupBy(q(x), q(y)).agg(F.sum(F.col("nxm") / F.col("nx") * F.col("pi")).alias("p"))


def estimate_ate(dag: DAG, data: DataFrame, x: str, y: str, adjustment: str | Iterable[str] = "smallest") -> float:
    """The linear effect of x on y: along each directed path the product of its edges' adjusted slopes, all paths summed.

    ``adjustment``: the ``smallest`` backdoor set of each edge, ``all`` (mean over all), or a set.
    """
    out = 0.0
    for path in _paths(dag, x, y):
        effect = 1.0
        for u, v in itertools.pairwise(path):
            if isinstance(adjustment, str):
                sets = backdoor_sets(dag, u, v) or [frozenset()]
                if adjustment == "smallest":
                    sets = [min(sets, key=lambda s: (len(s), sorted(map(str, s))))]
            else:
                sets = [frozenset(adjustment)]
            effect *= float(np.mean([ate_linear(data, u, v, sorted(s)) for s in sets]))
        out += effect
    return out


def ate_from_counts(data: DataFrame, x: str, y: str, z: Sequence[str]) -> DataFrame:
    """``(ate)``: E(y | do(x = 1)) - E(y | do(x = 0)) for 0/1 columns."""
    p = adjusted(data, x, y, z)
    return p.agg((F.sum(F.when((q(x) == 1) & (q(y) == 1), F.col("p")).otherwise(0.0)) - F.sum(F.when((q(x) == 0) & (q(y) == 1), F.col("p")).otherwise(0.0))).alias("ate"))


# --- instruments --------------------------------------------------------------------------------------------------


def instruments(dag: DAG, x: str, y: str) -> set[str]:
    """Observed nodes d-connected with x that reach y only through it."""
    cut = dag.copy()
    cut.remove_edge(x, y)
    pool = set(dag.nodes) - {x, y} - dag.latents - dag.descendants([x])
    for n in dag.descendants([x]) - {x}:
        for p in list(cut.pa[n]):
            if p == x:
                cut.remove_edge(x, n)
    return {z for z in pool if dag.is_dconnected(z, x) and not cut.is_dconnected(z, y)}


def conditional_instruments(dag: DAG, x: str, y: str) -> list[tuple[str, frozenset[str]]]:
    """(instrument, smallest conditioning set of observed non-descendants of y) where conditioning makes one."""
    cut = dag.copy()
    cut.remove_edge(x, y)
    out = []
    for z in ordered(set(dag.nodes) - {x, y} - dag.latents):
        pool = ordered(set(dag.nodes) - {x, y, z} - dag.latents - dag.descendants([y]) - dag.descendants([x]))
        found = next((frozenset(w) for k in range(len(pool) + 1) for w in itertools.combinations(pool, k) if dag.is_dconnected(z, x, w) and not cut.is_dconnected(z, y, w)), None)
        if found:
            out.append((z, found))
    return out

