"""Markov networks, factor graphs and clique trees: exact queries by messages, MAP by dual decomposition."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.operators.factors import VALUE, Factor, grid, product
from credalis.operators.network import BayesianNetwork
from credalis.plans import elimination
from credalis.plans.graph import DAG, Graph, ordered


class MarkovNetwork:
    """A product of factors over an undirected graph."""

    def __init__(self, factors: Iterable[Factor] = (), edges: Iterable[tuple[str, str]] = ()):
        self.factors = list(factors)
        self.graph = elimination.scope_graph(f.variables for f in self.factors)
        for u, v in edges:
            self.graph.add_edge(u, v)

    @classmethod
    def of(cls, net: BayesianNetwork) -> MarkovNetwork:
        """The moral network."""
        return cls([c.to_factor() for c in net.cpds.values()], net.dag.moralize().edges)

    @property
    def states(self) -> dict[str, list]:
        return {v: s for f in self.factors for v, s in f.states.items()}

    def partition_function(self) -> float:
        f = BayesianNetwork()._eliminate([], self.factors, "greedy")
        return float(f.df.agg(F.sum(VALUE)).first()[0])

    def query(self, variables: Sequence[str], evidence: dict[str, object] | None = None, order: str = "greedy") -> Factor:
        evidence = evidence or {}
        some = [f.reduce({v: s for v, s in evidence.items() if v in f.states}) for f in self.factors]
        return BayesianNetwork()._eliminate(list(variables), some, order).normalize()

    def triangulate(self, heuristic: str = "MinFill") -> Graph:
        return elimination.triangulated(self.graph, {v: len(s) for v, s in self.states.items()}, heuristic)

    def junction_tree(self) -> JunctionTree:
        return JunctionTree(self)

    def to_bayesian(self) -> DAG:
        """A DAG without fewer connections: each clique of the tree directed along an elimination order."""
        g = self.triangulate()
        order = g.search_order()
        at = {n: i for i, n in enumerate(order)}
        return DAG([(u, v) if at[u] < at[v] else (v, u) for u, v in g.edges], order)

    def local_independencies(self):
        return self.graph.local_independencies()

    def markov_blanket(self, n: str) -> list[str]:
        return self.graph.neighbors(n)


class FactorGraph(MarkovNetwork):
    """The same product, seen as a bipartite graph of variables and factors."""

    @property
    def edges(self) -> list[tuple[str, int]]:
        return [(v, i) for i, f in enumerate(self.factors) for v in f.variables]

    def propagate(self, variables: Sequence[str], evidence: dict[str, object] | None = None, virtual_evidence: Sequence[Factor] = ()) -> dict[str, Factor]:
        """Sum-product messages on a tree, each once in each direction at most; likelihoods join at their variable."""
        evidence = evidence or {}
        factors = [f.reduce({v: s for v, s in evidence.items() if v in f.states}) for f in self.factors] + list(virtual_evidence)
        touch: dict[str, list[int]] = {}
        for i, f in enumerate(factors):
            for v in f.variables:
                touch.setdefault(v, []).append(i)
        memo: dict[tuple, Factor | None] = {}

        def to_variable(i: int, v: str) -> Factor:
            if ("f", i, v) not in memo:
                parts = [factors[i]] + [m for u in factors[i].variables if u != v and (m := to_factor(u, i)) is not None]
                memo["f", i, v] = product(*parts)._fold([u for u in factors[i].variables if u != v], F.sum)
            return memo["f", i, v]

        def to_factor(v: str, i: int) -> Factor | None:
            if ("v", v, i) not in memo:
                parts = [to_variable(j, v) for j in touch[v] if j != i]
                memo["v", v, i] = product(*parts) if parts else None
            return memo["v", v, i]

        return {v: product(*[to_variable(i, v) for i in touch[v]]).normalize() for v in variables}


class JunctionTree:
    """Cliques with potentials; ``calibrate`` makes neighbours agree on what they share."""

    def __init__(self, net: MarkovNetwork):
        states = net.states
        cards = {v: len(s) for v, s in states.items()}
        self.states = states
        self.cliques, self.edges = elimination.clique_tree(net.graph, cards)
        spark = net.factors[0].df.sparkSession
        self.potentials = [Factor(grid(spark, ordered(c), states).withColumn(VALUE, F.lit(1.0)), ordered(c), states) for c in self.cliques]
        for f in net.factors:
            home = next(i for i, c in enumerate(self.cliques) if f.scope <= c)
            self.potentials[home] = self.potentials[home].product(f)
        self.beliefs: list[Factor] | None = None
        self.separators: dict[tuple[int, int], Factor] = {}

    def _rooted(self) -> list[tuple[int, int]]:
        """(child, parent) pairs from the leaves up, in every tree of the forest."""
        near: dict[int, list[int]] = {i: [] for i in range(len(self.cliques))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)
        out, seen = [], set()
        for root in near:
            if root in seen:
                continue
            seen.add(root)
            todo = [root]
            while todo:
                i = todo.pop(0)
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        out.append((j, i))
                        todo.append(j)
        return out[::-1]

    def calibrate(self, how=F.sum) -> JunctionTree:
        """Two passes of belief update: each message is a grouped aggregate, divided by the last one over the same separator.
        Messages and beliefs are settled, so that plans don't grow along the tree."""
        self.beliefs, self.separators = list(self.potentials), {}
        up = self._rooted()

        def send(i: int, j: int) -> None:
            shared = self.cliques[i] & self.cliques[j]
            message = self.beliefs[i]._fold([v for v in self.beliefs[i].variables if v not in shared], how).settled()
            edge = (min(i, j), max(i, j))
            old = self.separators.get(edge)
            self.beliefs[j] = self.beliefs[j].product(message if old is None else message.divide(old)).settled()
            self.separators[edge] = message

        for child, parent in up:
            send(child, parent)
        for child, parent in up[::-1]:
            send(parent, child)
        return self

    def max_calibrate(self) -> JunctionTree:
        return self.calibrate(F.max)

    def query(self, variables: Sequence[str], evidence: dict[str, object] | None = None) -> Factor:
        """From the calibrated beliefs: the cliques that span the variables, divided by their separators, then elimination."""
        if self.beliefs is None:
            self.calibrate()
        evidence = evidence or {}
        needed = {*variables, *evidence}
        keep = set(range(len(self.cliques)))
        edges = set(self.edges)
        while True:  # leaves that hold nothing asked for beyond their neighbour go
            leaf = next((i for i in sorted(keep) if (own := [e for e in edges if i in e]) is not None and (len(own) == 1 and needed & self.cliques[i] <= self.cliques[own[0][0] if own[0][1] == i else own[0][1]] or not own and not needed & self.cliques[i] and len(keep) > 1)), None)
            if leaf is None:
                break
            keep.discard(leaf)
            edges = {e for e in edges if leaf not in e}
        factors = []
        for i in sorted(keep):
            b = self.beliefs[i]
            for e in list(edges):
                # each separator divides one of its cliques
                if max(e, key=sorted(keep).index) == i:
                    b = b.divide(self.separators[tuple(sorted(e))])
            factors.append(b.reduce({v: s for v, s in evidence.items() if v in b.states}))
        return BayesianNetwork()._eliminate(list(variables), factors, "greedy").normalize()

    def map_query(self, variables: Sequence[str], evidence: dict[str, object] | None = None) -> dict[str, object]:
        return self.query(variables, evidence).argmax()

    def fit_potentials(self, data: DataFrame) -> FactorGraph:
        """Clique counts divided by those of the separators: the maximum likelihood potentials."""
        seen: set[str] = set()
        out = []
        for i in [p for _, p in self._rooted()[::-1][:1]] + [c for c, _ in self._rooted()[::-1]] or [0]:
            f = Factor.from_data(data, ordered(self.cliques[i]), self.states).normalize()
            if shared := ordered(self.cliques[i] & seen):
                f = f.divide(f.marginalize([v for v in f.variables if v not in shared]))
            seen |= self.cliques[i]
            out.append(f)
        return FactorGraph(out)


# --- MAP by dual decomposition --------------------------------------------------------------------------------------


class Mplp:
    """MAP of a Markov network by block coordinate descent of the dual, with triplets where it stays loose. Tables are small and on the driver."""

    def __init__(self, net: MarkovNetwork):
        self.states = net.states
        self.names = ordered(self.states)
        self.unary = {v: np.zeros(len(self.states[v])) for v in self.names}
        self.clusters: dict[tuple[str, ...], np.ndarray] = {}
        for f in net.factors:
            log = np.log(np.maximum(f.values(), 1e-300))
            if len(f.variables) == 1:
                self.unary[f.variables[0]] = self.unary[f.variables[0]] + log
            else:
                key = tuple(sorted(f.variables))
                log = np.transpose(log, [f.variables.index(v) for v in key])
                self.clusters[key] = self.clusters.get(key, 0) + log
        self.messages = {(c, v): np.zeros(len(self.states[v])) for c in self.clusters for v in c}
        self.dual = self.value = 0.0

    def _belief(self, v: str) -> np.ndarray:
        return self.unary[v] + sum((m for (c, u), m in self.messages.items() if u == v), np.zeros(len(self.states[v])))

    def _sweep(self) -> None:
        for c, table in self.clusters.items():
            rest = {v: self._belief(v) - self.messages[c, v] for v in c}
            total = table.copy()
            for i, v in enumerate(c):
                total = total + rest[v].reshape([-1 if k == i else 1 for k in range(len(c))])
            for i, v in enumerate(c):
                best = total.max(tuple(k for k in range(len(c)) if k != i))
                self.messages[c, v] = best / len(c) - rest[v]

    def _bound(self) -> float:
        out = sum(float(self._belief(v).max()) for v in self.names)
        for c, table in self.clusters.items():
            t = table.copy()
            for i, v in enumerate(c):
                t = t - self.messages[c, v].reshape([-1 if k == i else 1 for k in range(len(c))])
            out += float(t.max())
        return out

    def score(self, at: dict[str, int]) -> float:
        return sum(float(self.unary[v][at[v]]) for v in self.names) + sum(float(t[tuple(at[v] for v in c)]) for c, t in self.clusters.items())

    def map_query(self, rounds: int = 1000, threshold: float = 2e-4, triplets: int = 5, tighten: bool = True, tighten_rounds: int = 10) -> dict[str, object]:
        best: dict[str, int] = {}
        self.value = -np.inf
        for stage in range(tighten_rounds + 1 if tighten else 1):
            last = np.inf
            for _ in range(rounds if stage == 0 else max(20, rounds // 10)):
                self._sweep()
                self.dual = self._bound()
                at = {v: int(self._belief(v).argmax()) for v in self.names}
                if (s := self.score(at)) > self.value:
                    self.value, best = s, at
                if last - self.dual < threshold * 1e-2 or self.dual - self.value < threshold:
                    break
                last = self.dual
            if self.dual - self.value < threshold or not tighten or not self._add_triplets(triplets):
                break
        return {v: self.states[v][k] for v, k in best.items()}

    def integrality_gap(self) -> float:
        return self.dual - self.value

    def triangles(self) -> list[tuple[str, str, str]]:
        g = elimination.scope_graph(self.clusters)
        return [(u, v, w) for u, v, w in itertools.combinations(self.names, 3) if g.is_clique((u, v, w))]

    def _add_triplets(self, most: int) -> bool:
        """Clusters of three that disagree most about their pairs."""
        gains = []
        for t in self.triangles():
            if t in self.clusters:
                continue
            parts, total = 0.0, np.zeros([len(self.states[v]) for v in t])
            for a, b in itertools.combinations(range(3), 2):
                c = (t[a], t[b])
                table = self.clusters.get(c, np.zeros([len(self.states[v]) for v in c]))
                for i, v in enumerate(c):
                    table = table - self.messages.get((c, v), np.zeros(len(self.states[v]))).reshape([-1 if k == i else 1 for k in range(2)])
                parts += float(table.max())
                total = total + np.expand_dims(table, 3 - a - b)
            gains.append((parts - float(total.max()), t))
        chosen = [t for g, t in sorted(gains, key=lambda x: (-x[0], x[1]))[:most] if g > 1e-9]
        for t in chosen:
            table = np.zeros([len(self.states[v]) for v in t])
            for a, b in itertools.combinations(range(3), 2):
                c = (t[a], t[b])
                if c in self.clusters:  # the pair's table moves into the triplet
                    table = table + np.expand_dims(self.clusters.pop(c), 3 - a - b)
                    for v in c:
                        self.messages.pop((c, v))
            self.clusters[t] = table
            self.messages |= {(t, v): np.zeros(len(self.states[v])) for v in t}
        return bool(chosen)


# --- fitting marginals ----------------------------------------------------------------------------------------------


def mirror_descent(spark: SparkSession, marginals: dict[tuple[str, ...], np.ndarray], states: dict[str, list], total: float = 1.0, rounds: int = 200, step: float = 1.0, metric: str = "L2") -> tuple[dict[tuple[str, ...], np.ndarray], float]:
    """(clique potentials, loss): potentials of a clique tree, whose marginals come as close to the given ones as mirror descent gets.
    Marginals are counted by Spark once; the descent is over small tables."""
    names = ordered(states)
    scope = {c: tuple(sorted(c)) for c in marginals}
    want = {scope[c]: np.transpose(m, [list(c).index(v) for v in scope[c]]) / total for c, m in marginals.items()}
    theta = {c: np.zeros_like(m, dtype=float) for c, m in want.items()}
    shape = [len(states[v]) for v in names]

    def spread(c: tuple[str, ...], t: np.ndarray) -> np.ndarray:
        return t.reshape([len(states[v]) if v in c else 1 for v in names])

    def project() -> dict[tuple[str, ...], np.ndarray]:
        log = np.zeros(shape)
        for c, t in theta.items():
            log = log + spread(c, t)
        p = np.exp(log - log.max())
        p /= p.sum()
        return {c: p.sum(tuple(i for i, v in enumerate(names) if v not in c)) for c in theta}

    def loss(mu: dict) -> float:
        return sum(float(np.abs(mu[c] - want[c]).sum() if metric == "L1" else 0.5 * ((mu[c] - want[c]) ** 2).sum()) for c in want)

    mu = project()
    now = loss(mu)
    for _ in range(rounds):
        gradient = {c: np.sign(mu[c] - want[c]) if metric == "L1" else mu[c] - want[c] for c in want}
        before = {c: t.copy() for c, t in theta.items()}
        for _ in range(25):
            for c in theta:
                theta[c] = before[c] - step * gradient[c]
            mu = project()
            if loss(mu) <= now:
                step *= 1.5
                break
            step /= 2
        if abs(now - loss(mu)) < 1e-15:
            break
        now = loss(mu)
    return theta, now

