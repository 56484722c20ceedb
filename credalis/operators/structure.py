"""Structure learning. The driver proposes; each step's candidates are counted together, so the number of Spark jobs grows
with the number of steps, not of candidates."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame

from credalis.operators.citests import CITests
from credalis.operators.counts import contingency, family_counts
from credalis.operators.scores import Score
from credalis.plans.graph import DAG, PDAG, Graph, ordered

Operation = tuple[str, tuple[str, str]]


def operations(dag: DAG, allowed: Callable[[str, str], bool], fixed: set[tuple[str, str]], max_indegree: float) -> Iterator[Operation]:
    """Additions, removals and reversals that keep the graph acyclic, in the order of names."""
    for u, v in itertools.permutations(ordered(dag.nodes), 2):
        if not dag.has_edge(u, v) and not dag.has_edge(v, u) and allowed(u, v) and len(dag.pa[v]) < max_indegree and not dag.reaches(v, u):
            yield "+", (u, v)
    for u, v in sorted(dag.edges):
        if (u, v) not in fixed:
            yield "-", (u, v)
            if allowed(v, u) and len(dag.pa[u]) < max_indegree and not any(dag.reaches(c, v) for c in dag.ch[u] if c != v):
                yield "flip", (u, v)


def _families(dag: DAG, op: Operation) -> list[tuple[str, frozenset[str]]]:
    kind, (u, v) = op
    pu, pv = frozenset(dag.pa[u]), frozenset(dag.pa[v])
    if kind == "+":
        return [(v, pv | {u})]
    return [(v, pv - {u})] if kind == "-" else [(v, pv - {u}), (u, pu | {v})]


def _gain(dag: DAG, op: Operation, score) -> float:
    return sum(score.local(n, p) - score.local(n, dag.pa[n]) for n, p in _families(dag, op)) + score.prior_ratio(op[0])


def _apply(dag: DAG, op: Operation) -> None:
    kind, (u, v) = op
    if kind != "+":
        dag.remove_edge(u, v)
    if kind != "-":
        dag.add_edge(*((u, v) if kind == "+" else (v, u)))


def hill_climb(score, nodes: Sequence[str], start: DAG | None = None, fixed: Iterable[tuple[str, str]] = (), black: Iterable[tuple[str, str]] = (), white: Iterable[tuple[str, str]] | None = None, max_indegree: float = math.inf, tabu: int = 100, epsilon: float = 1e-4, rounds: int = 1_000_000) -> DAG:
    """Greedy search over additions, removals and reversals; recent operations aren't undone. Ties: the first by kind and names."""
    dag = start.copy() if start else DAG(nodes=nodes)
    fixed, black = set(fixed), set(black)
    white = None if white is None else set(white)
    for e in fixed:
        dag.add_edge(*e)
    recent: deque[Operation] = deque(maxlen=tabu)
    for _ in range(rounds):
        ops = [o for o in operations(dag, lambda u, v: (u, v) not in black and (white is None or (u, v) in white), fixed, max_indegree) if o not in recent]
        score.prefetch([f for o in ops for f in _families(dag, o)] + [(n, dag.pa[n]) for n in dag.nodes])
        best = max(ops, key=lambda o: _gain(dag, o, score), default=None)
        if best is None or _gain(dag, best, score) < epsilon:
            break
        _apply(dag, best)
        u, v = best[1]
        recent.append({"+": ("-", (u, v)), "-": ("+", (u, v)), "flip": ("flip", (v, u))}[best[0]])
    return dag


def greedy_equivalence(score, nodes: Sequence[str], epsilon: float = 1e-9) -> DAG:
    """Additions while they gain, then removals, then reversals."""
    dag = DAG(nodes=nodes)
    for kind in ("+", "-", "flip"):
        while True:
            ops = [o for o in operations(dag, lambda u, v: True, set(), math.inf) if o[0] == kind]
            score.prefetch([f for o in ops for f in _families(dag, o)] + [(n, dag.pa[n]) for n in dag.nodes])
            best = max(ops, key=lambda o: _gain(dag, o, score), default=None)
            if best is None or _gain(dag, best, score) <= epsilon:
                break
            _apply(dag, best)
    return dag


def all_dags(nodes: Sequence[str]) -> Iterator[DAG]:
    """Every DAG over the nodes; their number explodes beyond five or six."""
    pairs = list(itertools.combinations(nodes, 2))
    for choice in itertools.product((0, 1, 2), repeat=len(pairs)):
        edges = [(u, v) if c == 1 else (v, u) for (u, v), c in zip(pairs, choice, strict=True) if c]
        try:
            yield DAG(edges, nodes)
        except ValueError:
            continue


def exhaustive(score, nodes: Sequence[str]) -> list[tuple[float, DAG]]:
    """All DAGs by ascending score; every family is counted in one batch."""
    score.prefetch([(n, p) for n in nodes for k in range(len(nodes)) for p in itertools.combinations([m for m in nodes if m != n], k)])
    return sorted(((score.score(d), d) for d in all_dags(nodes)), key=lambda x: (x[0], str(sorted(x[1].edges))))


# --- constraint-based ---------------------------------------------------------------------------------------------


def skeleton(tests, nodes: Sequence[str], variant: str = "stable", max_cond: int = 5, level: float = 0.01) -> tuple[Graph, dict[frozenset[str], frozenset[str]]]:
    """(undirected graph, separating sets): edges go as growing conditioning sets make their ends independent. With ``stable``
    the neighbours of a level are those at its start, so all its tests are counted at once."""
    g = Graph(itertools.combinations(nodes, 2), nodes)
    apart: dict[frozenset[str], frozenset[str]] = {}
    for size in range(max_cond + 1):
        if all(len(g.near[n]) - 1 < size for n in nodes):
            break
        near = {n: set(g.near[n]) for n in nodes} if variant != "orig" else g.near
        edges = sorted(g.edges, key=str)
        sets = lambda u, v: itertools.chain(itertools.combinations(ordered(near[u] - {v}), size), itertools.combinations(ordered(near[v] - {u}), size))
        tests.prefetch([(u, v, z) for u, v in edges for z in sets(u, v)])
        for u, v in edges:
            for z in list(sets(u, v)):
                if tests.independent(u, v, z, level):
                    g.near[u].discard(v)
                    g.near[v].discard(u)
                    apart[frozenset((u, v))] = frozenset(z)
                    break
    return g, apart


def orient(g: Graph, apart: dict[frozenset[str], frozenset[str]]) -> PDAG:
    """Colliders from the separating sets, then Meek's rules."""
    pdag = PDAG((), g.edges, g.nodes)
    for u, v in itertools.combinations(ordered(g.nodes), 2):
        if v not in g.near[u]:
            for n in ordered(g.near[u] & g.near[v]):
                if n not in apart.get(frozenset((u, v)), ()) and (n, u) not in pdag.directed and (n, v) not in pdag.directed:
                    pdag.orient(u, n)
                    pdag.orient(v, n)
    return pdag.oriented()


def pc(tests, nodes: Sequence[str], variant: str = "stable", max_cond: int = 5, level: float = 0.01, return_type: str = "dag") -> DAG | PDAG | tuple[Graph, dict]:
    g, apart = skeleton(tests, nodes, variant, max_cond, level)
    if return_type == "skeleton":
        return g, apart
    pdag = orient(g, apart)
    return pdag if return_type in ("pdag", "cpdag") else pdag.to_dag()


def mmpc(tests: CITests, nodes: Sequence[str], level: float = 0.01) -> dict[str, set[str]]:
    """Candidate parents and children: grown by the largest smallest association, shrunk by independence, made symmetric."""

    def association(x: str, y: str, zs: list[tuple[str, ...]]) -> float:
        tests.prefetch([(x, y, z) for z in zs])
        return min(1 - p if p < level else 0.0 for p in (tests.test(x, y, z)[1] for z in zs))

    out: dict[str, set[str]] = {}
    for t in nodes:
        near: list[str] = []
        while True:
            zs = [z for k in range(len(near) + 1) for z in itertools.combinations(near, k)]
            rest = [n for n in nodes if n != t and n not in near]
            tests.prefetch([(t, n, z) for n in rest for z in zs])
            best = max(rest, key=lambda n: association(t, n, zs), default=None)
            if best is None or association(t, best, zs) <= 0:
                break
            near.append(best)
        for n in list(near):
            others = [m for m in near if m != n]
            zs = [z for k in range(len(others) + 1) for z in itertools.combinations(others, k)]
            if association(t, n, zs) <= 0:
                near.remove(n)
        out[t] = set(near)
    return {t: {n for n in near if t in out[n]} for t, near in out.items()}


def mmhc(data: DataFrame, score, tabu: int = 10, level: float = 0.01) -> DAG:
    """Hill climbing among the edges that max-min parents and children leaves."""
    nodes = list(data.columns)
    near = mmpc(CITests(data), nodes, level)
    return hill_climb(score, nodes, white=[(u, v) for u in nodes for v in near[u]], tabu=tabu)


def expert_in_loop(data: DataFrame, orientation: Callable[[str, str], tuple[str, str] | None], pval: float = 0.05, effect: float = 0.05) -> DAG:
    """Adds, again and again, the pair with the largest effect that the graph doesn't explain, directed by the callback; edges
    that have lost their effect go."""
    from credalis.operators.citests import pillai_trace

    dag, refused = DAG(nodes=data.columns), set()
    while True:
        effects = {}
        for u, v in itertools.combinations(dag.nodes, 2):
            z = ordered((dag.pa[u] | dag.pa[v]) - {u, v})
            effects[u, v] = pillai_trace(data, u, v, z)
        for (u, v), (e, p) in effects.items():
            if (dag.has_edge(u, v) or dag.has_edge(v, u)) and (e < effect or p > pval):
                dag.remove_edge(u, v)
                dag.remove_edge(v, u)
                refused.add((u, v))
        open_pairs = {k: e for k, (e, p) in effects.items() if e >= effect and p <= pval and k not in refused and not dag.has_edge(*k) and not dag.has_edge(*k[::-1])}
        if not open_pairs:
            return dag
        pair = max(sorted(open_pairs), key=open_pairs.get)
        edge = orientation(*pair)
        if edge is None or dag.reaches(edge[1], edge[0]):
            refused.add(pair)
        else:
            dag.add_edge(*edge)


# --- trees --------------------------------------------------------------------------------------------------------


def entropy(counts: Iterable[float]) -> float:
    counts = [c for c in counts if c]
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts)


def mutual(counts: dict[tuple, float]) -> float:
    """In nats, of counts by (x, y)."""
    xs, ys, total = defaultdict(float), defaultdict(float), sum(counts.values())
    for (x, y), n in counts.items():
        xs[x] += n
        ys[y] += n
    return sum(n / total * math.log(n * total / (xs[x] * ys[y])) for (x, y), n in counts.items() if n)


def expected_mutual(a: Sequence[float], b: Sequence[float], n: float) -> float:
    """The mean mutual information of random tables with these margins."""
    g, out = math.lgamma, 0.0
    for x in a:
        for y in b:
            for k in range(max(1, int(x + y - n)), int(min(x, y)) + 1):
                log_p = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1)
                out += k / n * math.log(n * k / (x * y)) * math.exp(log_p)
    return out


def edge_weight(counts: dict[tuple, float], kind: str | Callable[[dict[tuple, float]], float] = "mutual_info") -> float:
    if callable(kind):
        return kind(counts)
    mi = mutual(counts)
    if kind == "mutual_info":
        return mi
    xs, ys = defaultdict(float), defaultdict(float)
    for (x, y), n in counts.items():
        xs[x] += n
        ys[y] += n
    mean = (entropy(xs.values()) + entropy(ys.values())) / 2
    if kind == "normalized_mutual_info":
        return mi / mean if mean else 1.0
    chance = expected_mutual(list(xs.values()), list(ys.values()), sum(xs.values()))
    return (mi - chance) / (mean - chance) if mean != chance else 1.0


def weights(data: DataFrame, nodes: Sequence[str], kind="mutual_info", given: str | None = None) -> dict[tuple[str, str], float]:
    """Edge weights of all pairs, given the class node if there is one, from one batch of counts."""
    pairs = list(itertools.combinations(nodes, 2))
    extra = [given] if given else []
    counts = family_counts(data, [[*p, *extra] for p in pairs])
    out = {}
    for u, v in pairs:
        table = contingency(counts[frozenset([u, v, *extra])], [u, v, *extra], [u, v, *extra])
        strata: dict[tuple, dict[tuple, float]] = defaultdict(dict)
        for k, n in table.items():
            strata[k[2:]][k[:2]] = n
        total = sum(table.values())
        out[u, v] = sum(sum(s.values()) / total * edge_weight(s, kind) for s in strata.values())
    return out


def spanning_tree(nodes: Sequence[str], weight: dict[tuple[str, str], float], root: str) -> DAG:
    """Maximum spanning tree, directed away from the root."""
    w = weight | {(v, u): x for (u, v), x in weight.items()}
    dag, inside = DAG(nodes=nodes), {root}
    while len(inside) < len(nodes):
        u, v = max(((a, b) for a in ordered(inside) for b in ordered(set(nodes) - inside)), key=lambda e: w[e])
        dag.add_edge(u, v)
        inside.add(v)
    return dag


def chow_liu(data: DataFrame, root: str | None = None, kind="mutual_info", nodes: Sequence[str] | None = None) -> DAG:
    nodes = list(nodes or data.columns)
    w = weights(data, nodes, kind)
    return spanning_tree(nodes, w, root or max(nodes, key=lambda n: sum(x for e, x in w.items() if n in e)))


def tan(data: DataFrame, class_node: str, root: str | None = None, kind="mutual_info") -> DAG:
    """Tree-augmented naive Bayes: a tree over the features by weights given the class, which is everyone's parent."""
    nodes = [c for c in data.columns if c != class_node]
    w = weights(data, nodes, kind, class_node)
    dag = spanning_tree(nodes, w, root or max(nodes, key=lambda n: sum(x for e, x in w.items() if n in e)))
    for n in nodes:
        dag.add_edge(class_node, n)
    return dag


__all__ = ["Score", "chow_liu", "exhaustive", "greedy_equivalence", "hill_climb", "mmhc", "pc", "tan"]
