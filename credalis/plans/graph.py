"""Graphs on the driver: directed acyclic, partially directed and undirected graphs, and independence statements.

Nodes may be any hashable values; wherever a choice is free, nodes are taken in sorted order of their text, so results
don't depend on hashing.
"""

from __future__ import annotations

import random
from collections.abc import Hashable, Iterable, Iterator
from itertools import combinations, permutations

Node = Hashable


def ordered(nodes: Iterable[Node]) -> list[Node]:
    return sorted(nodes, key=str)


class DAG:
    """A directed acyclic graph. ``latents``: nodes that data don't show."""

    def __init__(self, edges: Iterable[tuple[Node, Node]] = (), nodes: Iterable[Node] = (), latents: Iterable[Node] = ()):
        self.pa: dict[Node, set[Node]] = {}
        self.ch: dict[Node, set[Node]] = {}
        self.latents = set(latents)
        for n in nodes:
            self.add_node(n)
        for u, v in edges:
            self.add_edge(u, v)

    def add_node(self, n: Node) -> None:
        self.pa.setdefault(n, set())
        self.ch.setdefault(n, set())

    def add_edge(self, u: Node, v: Node) -> None:
        if u == v:
            raise ValueError("self loops are not allowed")
        self.add_node(u)
        self.add_node(v)
        if v not in self.ch[u]:
            if self.reaches(v, u):
                raise ValueError(f"adding {u} -> {v} makes a cycle")
            self.ch[u].add(v)
            self.pa[v].add(u)

    def remove_edge(self, u: Node, v: Node) -> None:
        self.ch[u].discard(v)
        self.pa[v].discard(u)

    def remove_node(self, n: Node) -> None:
        for p in self.pa.pop(n):
            self.ch[p].discard(n)
        for c in self.ch.pop(n):
            self.pa[c].discard(n)

    @property
    def nodes(self) -> list[Node]:
        return list(self.pa)

    @property
    def edges(self) -> list[tuple[Node, Node]]:
        return [(u, v) for u in self.ch for v in ordered(self.ch[u])]

    def has_edge(self, u: Node, v: Node) -> bool:
        return v in self.ch.get(u, ())

    def parents(self, n: Node) -> list[Node]:
        return ordered(self.pa[n])

    def children(self, n: Node) -> list[Node]:
        return ordered(self.ch[n])

    def roots(self) -> list[Node]:
        return [n for n in self.pa if not self.pa[n]]

    def leaves(self) -> list[Node]:
        return [n for n in self.ch if not self.ch[n]]

    def copy(self) -> DAG:
        return DAG(self.edges, self.nodes, self.latents)

    def subgraph(self, nodes: Iterable[Node]) -> DAG:
        keep = set(nodes)
        return DAG([(u, v) for u, v in self.edges if u in keep and v in keep], [n for n in self.nodes if n in keep], self.latents & keep)

    def reaches(self, u: Node, v: Node) -> bool:
        return v in self.descendants([u])

    def descendants(self, nodes: Iterable[Node]) -> set[Node]:
        """The nodes and all below them."""
        return _closure(nodes, self.ch)

    def ancestors(self, nodes: Iterable[Node]) -> set[Node]:
        """The nodes and all above them."""
        return _closure(nodes, self.pa)

    def ancestral_graph(self, nodes: Iterable[Node]) -> DAG:
        return self.subgraph(self.ancestors(nodes))

    def topological(self) -> list[Node]:
        left = {n: len(p) for n, p in self.pa.items()}
        ready = [n for n in self.pa if not left[n]]
        out = []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for c in ordered(self.ch[n]):
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
        return out

    def moralize(self) -> Graph:
        g = Graph(self.edges, self.nodes)
        for n in self.nodes:
            for u, v in combinations(self.parents(n), 2):
                g.add_edge(u, v)
        return g

    def markov_blanket(self, n: Node) -> list[Node]:
        out = self.pa[n] | self.ch[n]
        for c in self.ch[n]:
            out |= self.pa[c]
        return ordered(out - {n})

    def active_trail(self, start: Node, observed: Iterable[Node] = ()) -> set[Node]:
        """All nodes d-connected with ``start`` given ``observed``, itself included unless observed."""
        z = set(observed)
        opened = self.ancestors(z & set(self.pa))
        seen: set[tuple[Node, bool]] = set()
        out, todo = set(), [(start, True)]  # (node, arrived from a child)
        while todo:
            n, up = todo.pop()
            if (n, up) in seen:
                continue
            seen.add((n, up))
            if n not in z:
                out.add(n)
            if up and n not in z:
                todo += [(p, True) for p in self.pa[n]] + [(c, False) for c in self.ch[n]]
            elif not up:
                if n not in z:
                    todo += [(c, False) for c in self.ch[n]]
                if n in opened:
                    todo += [(p, True) for p in self.pa[n]]
        return out

    def active_trail_nodes(self, variables: Node | list[Node], observed: Iterable[Node] = (), include_latents: bool = False) -> dict[Node, set[Node]]:
        some = variables if isinstance(variables, (list, tuple)) else [variables]
        return {v: self.active_trail(v, observed) - (set() if include_latents else self.latents) for v in some}

    def is_dconnected(self, u: Node, v: Node, observed: Iterable[Node] = ()) -> bool:
        return v in self.active_trail(u, observed)

    def minimal_dseparator(self, u: Node, v: Node) -> set[Node] | None:
        """A smallest-by-removal set that separates two nodes, None for neighbours; latent parents are replaced by theirs."""
        if self.has_edge(u, v) or self.has_edge(v, u):
            return None
        above = self.ancestral_graph([u, v])
        z = above.pa[u] | above.pa[v]
        while hidden := z & self.latents:
            z = (z - hidden).union(*(self.pa[h] for h in hidden))
        z -= {u, v}
        if above.is_dconnected(u, v, z):
            return None
        for n in ordered(z):
            if not above.is_dconnected(u, v, z - {n}):
                z = z - {n}
        return z

    def do(self, nodes: Iterable[Node]) -> DAG:
        """The graph without the edges into ``nodes``."""
        cut = set(nodes)
        return DAG([(u, v) for u, v in self.edges if v not in cut], self.nodes, self.latents)

    def local_independencies(self, n: Node) -> Independencies:
        rest = set(self.nodes) - self.descendants([n]) - self.pa[n]
        return Independencies((n, rest, self.pa[n])) if rest else Independencies()

    def independencies(self, include_latents: bool = False) -> Independencies:
        """All statements X _|_ Y | Z with single X that d-separation gives."""
        names = set(self.nodes) - (set() if include_latents else self.latents)
        out = Independencies()
        for n in ordered(names):
            rest = names - {n}
            for k in range(len(rest)):
                for z in combinations(ordered(rest), k):
                    if apart := rest - set(z) - self.active_trail(n, z):
                        out.add(Assertion({n}, apart, set(z)))
        return out

    def immoralities(self) -> set[tuple[frozenset[Node], Node]]:
        return {(frozenset((u, v)), n) for n in self.nodes for u, v in combinations(self.parents(n), 2) if not (self.has_edge(u, v) or self.has_edge(v, u))}

    def skeleton(self) -> set[frozenset[Node]]:
        return {frozenset(e) for e in self.edges}

    def is_iequivalent(self, other: DAG) -> bool:
        return self.skeleton() == other.skeleton() and self.immoralities() == other.immoralities()

    def to_pdag(self) -> PDAG:
        """The pattern of the equivalence class: colliders and what follows from them is directed."""
        into = {(p, n) for pair, n in self.immoralities() for p in pair}
        return PDAG(into, [e for e in self.edges if e not in into]).oriented()

    def to_dot(self) -> str:
        quote = lambda n: '"' + str(n).replace('"', r"\"") + '"'
        return "digraph {\n" + "".join(f"  {quote(n)};\n" for n in self.nodes) + "".join(f"  {quote(u)} -> {quote(v)};\n" for u, v in self.edges) + "}\n"

    @staticmethod
    def random(n: int = 5, edge_prob: float = 0.5, names: list[Node] | None = None, latents: bool = False, seed: int | None = None) -> DAG:
        rng = random.Random(seed)
        names = names or [f"X_{i}" for i in range(n)]
        dag = DAG([(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if rng.random() < edge_prob], names)
        if latents:
            dag.latents = {x for x in names if rng.random() < 0.5}
        return dag


def _closure(start: Iterable[Node], step: dict[Node, set[Node]]) -> set[Node]:
    out, todo = set(), list(start)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += step[n]
    return out


class PDAG:
    """A graph with directed and undirected edges."""

    def __init__(self, directed: Iterable[tuple[Node, Node]] = (), undirected: Iterable[tuple[Node, Node]] = (), nodes: Iterable[Node] = (), latents: Iterable[Node] = ()):
        self.directed = set(directed)
        self.undirected = {frozenset(e) for e in undirected}
        self.nodes = ordered({*nodes, *(n for e in self.directed for n in e), *(n for e in self.undirected for n in e)})
        self.latents = set(latents)

    def copy(self) -> PDAG:
        return PDAG(self.directed, [tuple(e) for e in self.undirected], self.nodes, self.latents)

    def adjacent(self, u: Node, v: Node) -> bool:
        return (u, v) in self.directed or (v, u) in self.directed or frozenset((u, v)) in self.undirected

    def orient(self, u: Node, v: Node) -> None:
        self.undirected.discard(frozenset((u, v)))
        self.directed.add((u, v))

    def oriented(self) -> PDAG:
        """Meek's first three rules, until none applies."""
        g = self.copy()
        changed = True
        while changed:
            changed = False
            for e in sorted(g.undirected, key=lambda e: sorted(map(str, e))):
                for u, v in permutations(ordered(e), 2):
                    into_u = [w for w, x in g.directed if x == u]
                    first = any(not g.adjacent(w, v) for w in into_u)
                    second = any((u, w) in g.directed and (w, v) in g.directed for w in g.nodes)
                    third = [w for w in g.nodes if frozenset((u, w)) in g.undirected and (w, v) in g.directed]
                    if first or second or any(not g.adjacent(a, b) for a, b in combinations(third, 2)):
                        g.orient(u, v)
                        changed = True
                        break
        return g

    def to_dag(self) -> DAG:
        """A DAG of the class: nodes without outgoing edges whose undirected neighbours are adjacent to all others are taken
        last-first; leftovers without such a node are directed by the order of names where that makes no cycle."""
        dag = DAG(self.directed, self.nodes, self.latents)
        left = set(self.nodes)
        open_edges = set(self.undirected)
        while left:
            for n in ordered(left):
                near = {next(iter(e - {n})) for e in open_edges if n in e}
                around = near | {u for u, v in self.directed if v == n and u in left}
                if not any(u == n and v in left for u, v in self.directed) and all(self.adjacent(a, b) for a in near for b in around if a != b):
                    for u in ordered(near):
                        dag.add_edge(u, n)
                    open_edges = {e for e in open_edges if n not in e}
                    left.discard(n)
                    break
            else:
                for e in sorted(open_edges, key=lambda e: sorted(map(str, e))):
                    u, v = ordered(e)
                    dag.add_edge(*((v, u) if dag.reaches(v, u) else (u, v)))
                break
        return dag

    def to_dot(self) -> str:
        return "digraph {\n" + "".join(f'  "{u}" -> "{v}";\n' for u, v in sorted(self.directed, key=str)) + "".join('  "{}" -> "{}" [dir=none];\n'.format(*ordered(e)) for e in sorted(self.undirected, key=lambda e: sorted(map(str, e)))) + "}\n"


class Graph:
    """An undirected graph."""

    def __init__(self, edges: Iterable[tuple[Node, Node]] = (), nodes: Iterable[Node] = ()):
        self.near: dict[Node, set[Node]] = {n: set() for n in nodes}
        for u, v in edges:
            self.add_edge(u, v)

    def add_edge(self, u: Node, v: Node) -> None:
        self.near.setdefault(u, set()).add(v)
        self.near.setdefault(v, set()).add(u)

    @property
    def nodes(self) -> list[Node]:
        return list(self.near)

    @property
    def edges(self) -> list[tuple[Node, Node]]:
        return sorted({tuple(ordered((u, v))) for u in self.near for v in self.near[u]}, key=str)

    def copy(self) -> Graph:
        return Graph(self.edges, self.nodes)

    def neighbors(self, n: Node) -> list[Node]:
        return ordered(self.near[n])

    def markov_blanket(self, n: Node) -> list[Node]:
        return self.neighbors(n)

    def is_clique(self, nodes: Iterable[Node]) -> bool:
        return all(v in self.near[u] for u, v in combinations(list(nodes), 2))

    def components(self) -> list[set[Node]]:
        out, seen = [], set()
        for n in self.near:
            if n not in seen:
                out.append(_closure([n], self.near))
                seen |= out[-1]
        return out

    def search_order(self) -> list[Node]:
        """Maximum cardinality search."""
        weight = dict.fromkeys(self.near, 0)
        out = []
        while weight:
            n = max(ordered(weight), key=lambda x: weight[x])
            out.append(n)
            del weight[n]
            for m in self.near[n]:
                if m in weight:
                    weight[m] += 1
        return out

    def is_triangulated(self) -> bool:
        seen: set[Node] = set()
        for n in self.search_order():
            if not self.is_clique(self.near[n] & seen):
                return False
            seen.add(n)
        return True

    def fill_order(self, order: Iterable[Node]) -> tuple[Graph, int]:
        """(the graph with the edges that eliminating in ``order`` adds, its width)."""
        filled, work, width = self.copy(), self.copy(), 0
        for n in order:
            near = ordered(work.near[n])
            width = max(width, len(near))
            for u, v in combinations(near, 2):
                work.add_edge(u, v)
                filled.add_edge(u, v)
            for m in near:
                work.near[m].discard(n)
            del work.near[n]
        return filled, width

    def maximal_cliques(self) -> Iterator[frozenset[Node]]:
        """Bron-Kerbosch with pivots."""

        def grow(r: set[Node], p: set[Node], x: set[Node]) -> Iterator[frozenset[Node]]:
            if not p and not x:
                yield frozenset(r)
                return
            pivot = max(ordered(p | x), key=lambda n: len(p & self.near[n]))
            for n in ordered(p - self.near[pivot]):
                yield from grow(r | {n}, p & self.near[n], x & self.near[n])
                p = p - {n}
                x = x | {n}

        if self.near:
            yield from grow(set(), set(self.near), set())

    def separated(self, u: Node, v: Node, z: Iterable[Node]) -> bool:
        z = set(z)
        return v not in _closure([u], {n: (s - z if n not in z else set()) for n, s in self.near.items()})

    def local_independencies(self) -> Independencies:
        return Independencies(*((n, set(self.near) - {n} - self.near[n], self.near[n]) for n in ordered(self.near) if set(self.near) - {n} - self.near[n]))


class Assertion:
    """X is independent of Y given Z. X and Y may change places."""

    def __init__(self, x, y, z=()):
        as_set = lambda a: frozenset(a) if isinstance(a, (set, frozenset, list, tuple)) else frozenset([a])
        self.x, self.y, self.z = as_set(x), as_set(y), as_set(z)

    @property
    def key(self) -> tuple:
        return frozenset((self.x, self.y)), self.z

    def __eq__(self, other) -> bool:
        return isinstance(other, Assertion) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __repr__(self) -> str:
        show = lambda s: ", ".join(map(str, ordered(s)))
        return f"({show(self.x)} ⟂ {show(self.y)}" + (f" | {show(self.z)})" if self.z else ")")

    def latex(self) -> str:
        show = lambda s: ", ".join(map(str, ordered(s)))
        return rf"{show(self.x)} \perp {show(self.y)} \mid {show(self.z) or chr(92) + 'emptyset'}"


class Independencies:
    """A set of assertions with the semi-graphoid axioms."""

    def __init__(self, *assertions):
        self.items: list[Assertion] = []
        for a in assertions:
            self.add(a if isinstance(a, Assertion) else Assertion(*a))

    def add(self, a: Assertion) -> None:
        if a not in self.items:
            self.items.append(a)

    def contains(self, a: Assertion) -> bool:
        return a in self.items

    __contains__ = contains

    def __eq__(self, other) -> bool:
        return isinstance(other, Independencies) and set(self.items) == set(other.items)

    def __iter__(self):
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    def variables(self) -> set[Node]:
        return set().union(*(a.x | a.y | a.z for a in self.items)) if self.items else set()

    def closure(self) -> Independencies:
        """Symmetry, decomposition, weak union and contraction, to a fixed point."""
        done: set[Assertion] = set()
        todo = list(self.items)
        while todo:
            a = todo.pop()
            if a in done:
                continue
            done.add(a)
            for x, y in ((a.x, a.y), (a.y, a.x)):
                if len(y) > 1:
                    for n in y:
                        todo.append(Assertion(x, y - {n}, a.z))
                        todo.append(Assertion(x, y - {n}, a.z | {n}))
            for b in list(done):
                for p, q in ((a, b), (b, a)):
                    for px, py in ((p.x, p.y), (p.y, p.x)):
                        for qx, qy in ((q.x, q.y), (q.y, q.x)):
                            # X _|_ Y | Z + W  and  X _|_ W | Z  give  X _|_ Y + W | Z
                            if px == qx and qy <= p.z and q.z == p.z - qy and not py & qy:
                                todo.append(Assertion(px, py | qy, q.z))
        return Independencies(*sorted(done, key=repr))

    def entails(self, other: Independencies) -> bool:
        have = set(self.closure().items)
        return all(a in have for a in other.items)

    def is_equivalent(self, other: Independencies) -> bool:
        return self.entails(other) and other.entails(self)

    def reduce(self) -> Independencies:
        """Without the assertions that the others entail."""
        kept = list(self.items)
        for a in list(kept):
            rest = [b for b in kept if b != a]
            if Independencies(*rest).entails(Independencies(a)):
                kept = rest
        return Independencies(*kept)

    def latex(self) -> list[str]:
        return [a.latex() for a in self.items]
