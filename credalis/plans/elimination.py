"""The planner of probabilistic queries: which factors matter, in which order variables are summed out, clique trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from credalis.plans.graph import DAG, Graph, Node, ordered

#: A plan whose largest intermediate relation would have more rows is refused, with a table of evidence more for each of its rows.
MAX_ROWS = 10_000_000
MAX_ROWS_EACH = 100_000
#: Combinations of evidence states that a step may list before it is cut down to those that occur.
FREE_ROWS = 10_000


def requisite(dag: DAG, variables: Iterable[Node], evidence: Iterable[Node], likelihoods: Iterable[Node] = ()) -> set[Node]:
    """The nodes whose tables a query needs: those whose parameters are d-connected with it given the evidence. Barren nodes and
    what the evidence cuts off drop out. ``likelihoods``: nodes with virtual evidence, which counts as an observed child."""
    wide = DAG(dag.edges, dag.nodes)
    for n in dag.nodes:
        wide.add_edge(("table", n), n)
    for n in likelihoods:
        wide.add_edge(n, ("likelihood", n))
    given = set(evidence) | {("likelihood", n) for n in likelihoods}
    near = set().union(*(wide.active_trail(v, given) for v in variables))
    return {n for n in dag.nodes if ("table", n) in near}


COSTS = {
    "MinFill": lambda g, n, cards: sum(v not in g.near[u] for u, v in combinations(g.near[n], 2)),
    "MinNeighbors": lambda g, n, cards: len(g.near[n]),
    "MinWeight": lambda g, n, cards: math.prod(cards[m] for m in g.near[n]),
    "WeightedMinFill": lambda g, n, cards: sum(cards[u] * cards[v] for u, v in combinations(g.near[n], 2) if v not in g.near[u]),
}


def _clique_sizes(g: Graph, n: Node, cards: dict[Node, int]) -> list[int]:
    """Sizes of the largest cliques that ``n`` and its neighbours form."""
    some = {n, *g.near[n]}
    around = Graph()
    for u in some:
        around.near[u] = g.near[u] & some
    return [math.prod(cards[v] for v in c) for c in around.maximal_cliques()]


def _clique_cost(how: Callable[[int, int, list[int]], float]) -> Callable[[Graph, Node, dict[Node, int]], float]:
    return lambda g, n, cards: how(math.prod(cards[v] for v in (n, *g.near[n])), cards[n], _clique_sizes(g, n, cards))


# s: size of the clique that deleting a variable makes; e: its cardinality; c: sizes of the cliques around it
COSTS |= {
    "H1": _clique_cost(lambda s, e, c: s),
    "H2": _clique_cost(lambda s, e, c: s / e),
    "H3": _clique_cost(lambda s, e, c: s - max(c)),
    "H4": _clique_cost(lambda s, e, c: s - sum(c)),
    "H5": _clique_cost(lambda s, e, c: s / max(c)),
    "H6": _clique_cost(lambda s, e, c: s / sum(c)),
}


def induced(scopes: Iterable[Iterable[Node]], order: Sequence[Node]) -> tuple[Graph, int]:
    """(the graph that eliminating in ``order`` induces over the scopes, its width)."""
    return scope_graph(scopes).fill_order(order)


def order_by(graph: Graph, nodes: Iterable[Node], cards: dict[Node, int], heuristic: str = "MinFill") -> list[Node]:
    """Greedy elimination order of ``nodes``; ties by name."""
    work, left, out = graph.copy(), set(nodes), []
    while left:
        n = min(ordered(left), key=lambda x: COSTS[heuristic](work, x, cards))
        for u, v in combinations(work.near[n], 2):
            work.add_edge(u, v)
        for m in work.near[n]:
            work.near[m].discard(n)
        del work.near[n]
        left.discard(n)
        out.append(n)
    return out


def scope_graph(scopes: Iterable[Iterable[Node]]) -> Graph:
    g = Graph()
    for s in scopes:
        s = list(s)
        for n in s:
            g.near.setdefault(n, set())
        for u, v in combinations(s, 2):
            g.add_edge(u, v)
    return g


def largest_step(scopes: Iterable[Iterable[Node]], order: Sequence[Node], cards: dict[Node, int]) -> int:
    """Rows of the largest intermediate relation of an elimination. With cards of 1 for evidence columns: for each row of evidence."""
    scopes, most = [set(s) for s in scopes], 1
    for n in order:
        touched = [s for s in scopes if n in s]
        joint = set().union(*touched) if touched else set()
        most = max(most, math.prod(cards[v] for v in joint))
        scopes = [s for s in scopes if n not in s] + [joint - {n}]
    rest = set().union(*scopes) if scopes else set()
    return max(most, math.prod(cards[v] for v in rest))


def triangulated(graph: Graph, cards: dict[Node, int] | None = None, heuristic: str = "MinFill", order: Sequence[Node] | None = None) -> Graph:
    if graph.is_triangulated() and order is None:
        return graph.copy()
    cards = cards or dict.fromkeys(graph.nodes, 2)
    return graph.fill_order(order or order_by(graph, graph.nodes, cards, heuristic))[0]


def clique_tree(graph: Graph, cards: dict[Node, int] | None = None) -> tuple[list[frozenset[Node]], list[tuple[int, int]]]:
    """(cliques, edges between their positions): a spanning forest with the largest separators."""
    cliques = sorted(triangulated(graph, cards).maximal_cliques(), key=lambda c: sorted(map(str, c)))
    edges, tree = [], list(range(len(cliques)))

    def root(i: int) -> int:
        while tree[i] != i:
            i = tree[i]
        return i

    for i, j in sorted(combinations(range(len(cliques)), 2), key=lambda e: (-len(cliques[e[0]] & cliques[e[1]]), e)):
        if cliques[i] & cliques[j] and root(i) != root(j):
            tree[root(i)] = root(j)
            edges.append((i, j))
    return cliques, edges
