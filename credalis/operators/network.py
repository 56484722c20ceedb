"""Bayesian networks over DataFrames: parameters, exact queries, batched prediction, simulation."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credalis.functions.random import uniform
from credalis.functions.storage import numbered, written
from credalis.operators.counts import contingency, family_counts, state_counts, state_names
from credalis.operators.factors import CPD, LOCAL_ROWS, VALUE, Factor, JointDistribution, grid, product, q
from credalis.plans import elimination
from credalis.plans.graph import DAG


def mle_cpd(data: DataFrame, variable: str, parents: Sequence[str] = (), states: dict[str, list] | None = None, weight: str | None = None) -> CPD:
    """Relative frequencies; a parent configuration that doesn't occur gets equal shares."""
    return smoothed_cpd(data, variable, parents, states, weight=weight, alpha=0.0)


def smoothed_cpd(data: DataFrame, variable: str, parents: Sequence[str] = (), states: dict[str, list] | None = None, weight: str | None = None, alpha: float | DataFrame = 1.0) -> CPD:
    """(N + alpha) / sum, per parent configuration. ``alpha``: pseudo-count of each cell, or a table (family..., alpha)."""
    parents = list(parents)
    states = states or state_names(data, [variable, *parents])
    counts = state_counts(data, variable, parents, weight, states)
    if isinstance(alpha, DataFrame):
        counts = counts.join(alpha, [variable, *parents], "left").withColumn("n", F.col("n") + F.coalesce("alpha", F.lit(0.0)))
    else:
        counts = counts.withColumn("n", F.col("n") + F.lit(float(alpha)))
    total = F.sum("n").over(Window.partitionBy(*map(q, parents)))
    share = F.when(total > 0, F.col("n").cast("double") / F.nullif(total.cast("double"), F.lit(0.0))).otherwise(1.0 / len(states[variable]))
    return CPD(counts.select(q(variable), *map(q, parents), share.alias(VALUE)), variable, parents, states)


def filled(counts: dict[tuple, float], family: Sequence[str], states: dict[str, list]) -> np.ndarray:
    """Counts by states as an array with one axis for each variable; states that aren't listed don't count."""
    out = np.zeros([len(states[n]) for n in family])
    place = [{s: i for i, s in enumerate(states[n])} for n in family]
    for k, n in counts.items():
        at = tuple(p.get(s) for p, s in zip(place, k, strict=True))
        if None not in at:
            out[at] += n
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    """Per parent configuration; equal shares where nothing was counted. One row for each state."""
    flat = counts.reshape(len(counts), -1)
    total = flat.sum(0)
    return np.where(total > 0, flat / np.where(total > 0, total, 1), 1 / len(flat))


#: Evidence of more columns is written and joined as one value.
WIDE = 8


def joined_back(rows: DataFrame, found: DataFrame, given: list[str]) -> DataFrame:
    """``rows`` with what was found for their evidence."""
    if not given:
        return rows.crossJoin(found)
    if len(given) <= WIDE:
        return rows.join(found, given, "left")
    found = written(found)
    rest = [q(c) for c in found.columns if c not in given]
    return rows.withColumn("_e", F.struct(*map(q, given))).join(found.select(F.struct(*map(q, given)).alias("_e"), *rest), "_e", "left").drop("_e")


def packed(factors: Sequence[Factor]) -> list[Factor]:
    """Fewer factors with the same product: small ones are multiplied on the driver, up to ``FREE_ROWS`` rows each."""
    groups: list[tuple[set[str], list[Factor]]] = []
    for f in factors:
        for scope, some in groups:
            if math.prod(len(s) for s in ({v: s for g in (*some, f) for v, s in g.states.items()}).values()) <= elimination.FREE_ROWS:
                scope |= f.scope
                some.append(f)
                break
        else:
            groups.append((set(f.scope), [f]))
    out = []
    for _, some in groups:
        if len(some) == 1:
            out += some
            continue
        states = {v: s for f in some for v, s in f.states.items()}
        at = {v: i for i, v in enumerate(states)}
        values = np.ones([len(s) for s in states.values()])
        for f in some:
            own = f.values().transpose(np.argsort([at[v] for v in f.variables]))
            values = values * own.reshape([len(s) if v in f.states else 1 for v, s in states.items()])
        out.append(Factor.of(some[0].df.sparkSession, list(states), values, states))
    return out


class BayesianNetwork:
    def __init__(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = (), latents: Iterable[str] = ()):
        self.dag = DAG(edges, nodes, latents)
        self.cpds: dict[str, CPD] = {}

    # --- structure and tables ---

    @property
    def nodes(self) -> list[str]:
        return self.dag.nodes

    @property
    def edges(self) -> list[tuple[str, str]]:
        return self.dag.edges

    @property
    def states(self) -> dict[str, list]:
        return {n: c.states[n] for n, c in self.cpds.items()}

    @property
    def cards(self) -> dict[str, int]:
        return {n: len(s) for n, s in self.states.items()}

    def add_cpds(self, *cpds: CPD) -> BayesianNetwork:
        for c in cpds:
            if set(c.parents) != self.dag.pa[c.variable]:
                raise ValueError(f"the table of {c.variable} has the parents {c.parents}, the graph {self.dag.parents(c.variable)}")
            self.cpds[c.variable] = c
        return self

    def remove_cpds(self, *variables: str) -> None:
        for v in variables:
            self.cpds.pop(v, None)

    def copy(self) -> BayesianNetwork:
        out = BayesianNetwork(self.edges, self.nodes, self.dag.latents)
        out.cpds = dict(self.cpds)
        return out

    def check_model(self) -> bool:
        for n in self.nodes:
            c = self.cpds.get(n)
            if c is None:
                raise ValueError(f"{n} has no table")
            if set(c.parents) != self.dag.pa[n] or any(c.states[p] != self.cpds[p].states[p] for p in c.parents):
                raise ValueError(f"the table of {n} doesn't fit its parents")
            if not c.is_valid():
                raise ValueError(f"the table of {n} doesn't sum to 1")
        return True

    @staticmethod
    def random(spark: SparkSession, n: int = 5, edge_prob: float = 0.5, states: int = 2, seed: int | None = None) -> BayesianNetwork:
        dag = DAG.random(n, edge_prob, seed=seed)
        out = BayesianNetwork(dag.edges, dag.nodes)
        names = {v: list(range(states)) for v in dag.nodes}
        return out.add_cpds(*[CPD.random(spark, v, dag.parents(v), names, None if seed is None else seed + i) for i, v in enumerate(dag.nodes)])

    def do(self, nodes: Iterable[str]) -> BayesianNetwork:
        """Without the edges into ``nodes``; their tables are averaged over the parents."""
        out = BayesianNetwork(self.dag.do(nodes).edges, self.nodes, self.dag.latents)
        cut = set(nodes)
        out.cpds = {v: c.marginalize(c.parents) if v in cut and c.parents else c for v, c in self.cpds.items()}
        return out

    # --- parameters ---

    def fit(self, data: DataFrame, prior: str | None = None, equivalent_sample_size: float = 5, pseudo_counts: dict[str, DataFrame] | float | None = None, weight: str | None = None, states: dict[str, list] | None = None, estimator: Callable[[BayesianNetwork, DataFrame], Iterable[CPD]] | None = None) -> BayesianNetwork:
        """Tables from data: maximum likelihood, or with a prior ``K2`` (1 each), ``BDeu`` or ``dirichlet``. ``estimator``: the
        caller's own way, which gives a table for each variable."""
        if estimator is not None:
            return self.add_cpds(*estimator(self, data))
        names = {v: (states or {}).get(v) or own for v, own in state_names(data, self.nodes).items()}
        counts = self._counts(data, names, weight)
        spark = data.sparkSession
        for v in self.nodes:
            family = [v, *self.dag.parents(v)]
            if prior is None:
                alpha: float | np.ndarray = 0.0
            elif prior == "K2":
                alpha = 1.0
            elif prior == "BDeu":
                alpha = equivalent_sample_size / math.prod(len(names[n]) for n in family)
            elif isinstance(pseudo_counts, dict):
                alpha = filled({tuple(r[n] for n in family): r["alpha"] for r in pseudo_counts[v].collect()}, family, names)
            else:
                alpha = float(pseudo_counts)
            self.cpds[v] = CPD.table(spark, v, shares(counts[v] + alpha), family[1:], {n: names[n] for n in family})
        return self

    def _counts(self, data: DataFrame, names: dict[str, list], weight: str | None = None) -> dict[str, np.ndarray]:
        """The counts of all families, from one scan; tables don't refer to the data afterwards."""
        families = {v: [v, *self.dag.parents(v)] for v in self.nodes}
        found = family_counts(data, families.values(), weight)
        return {v: filled(contingency(found[frozenset(f)], f, f), f, names) for v, f in families.items()}

    def fit_update(self, data: DataFrame, n_prev: float) -> BayesianNetwork:
        """Tables updated by new data: the old ones count as ``n_prev`` rows spread evenly over the parent configurations."""
        spark = data.sparkSession
        old = {v: c.reorder_parents(self.dag.parents(v)) for v, c in self.cpds.items()}
        counts = self._counts(data, self.states)
        for v, c in old.items():
            prior = c.values() * n_prev / math.prod(len(c.states[p]) for p in c.parents)
            self.cpds[v] = CPD.table(spark, v, shares(counts[v] + prior), c.parents, c.states)
        return self

    # --- exact queries ---

    def _reduced(self, variables: Sequence[str], evidence: dict[str, object], virtual: Sequence[Factor]) -> list[Factor]:
        likelihoods = [f.variables[0] for f in virtual]
        keep = elimination.requisite(self.dag, variables, evidence, likelihoods) if variables else self.dag.ancestors({*evidence, *likelihoods})
        out = [self.cpds[n].to_factor() for n in self.nodes if n in keep] + list(virtual)
        return [f.reduce({v: s for v, s in evidence.items() if v in f.states}) for f in out]

    def _eliminate(self, keep: Sequence[str], factors: list[Factor], order: str | Sequence[str], how=F.sum, lead: Factor | None = None) -> Factor:
        """Sums out all other variables, one join and grouped aggregate each. ``lead``: the rows of evidence whose columns are
        kept; steps with many combinations of evidence list only those that occur in it."""
        cards = {v: len(s) for f in factors for v, s in f.states.items()}
        scopes = [f.variables for f in factors]
        hidden = [v for v in cards if v not in keep]
        plan = list(order) if not isinstance(order, str) else elimination.order_by(elimination.scope_graph(scopes), hidden, cards, "MinFill" if order == "greedy" else order)
        if set(plan) != set(hidden):
            raise ValueError(f"the order must list exactly {sorted(hidden)}")
        given = set(lead.variables) if lead else set()
        each = cards | dict.fromkeys(given, 1)
        if (rows := elimination.largest_step(scopes, plan, cards)) > elimination.MAX_ROWS and (not lead or elimination.largest_step(scopes, plan, each) > elimination.MAX_ROWS_EACH):
            raise ValueError(f"an intermediate table would have {rows} rows; sample instead")

        def joined(some: list[Factor], whole: bool = False) -> Factor:
            own = [v for v in (lead.variables if lead else []) if whole or any(v in f.states for f in some)]
            if not own or not whole and math.prod(cards[v] for v in own) <= elimination.FREE_ROWS:
                return product(*some)
            first = lead if whole else Factor(lead.df.select(*map(q, own)).distinct().withColumn(VALUE, F.lit(1.0)), own, lead.states)
            # each table joins on the evidence or on what is joined already
            left, out = packed(some), first
            while left:
                f = next((f for f in left if out.scope & f.scope), left[0])
                left.remove(f)
                out = out.product(f)
            return out

        for v in plan:
            touched = [f for f in factors if v in f.states]
            factors = [f for f in factors if v not in f.states] + [joined(touched)._fold([v], how)]
        out = joined(factors, whole=lead is not None)
        return Factor(out.df, list(keep), out.states) if keep else out

    def query(self, variables: Sequence[str], evidence: dict[str, object] | None = None, virtual_evidence: Sequence[Factor] = (), order: str | Sequence[str] = "greedy", joint: bool = True) -> Factor | dict[str, Factor]:
        """P(variables | evidence). ``virtual_evidence``: likelihoods over one variable each."""
        evidence = evidence or {}
        if set(variables) & set(evidence):
            raise ValueError("a variable can't be both asked for and given")
        out = self._eliminate(list(variables), self._reduced(variables, evidence, virtual_evidence), order).normalize()
        return out if joint else {v: out.marginalize([u for u in variables if u != v]) for v in variables}

    def induced_width(self, order: Sequence[str]) -> int:
        """The width of the graph that eliminating all variables in ``order`` induces."""
        return elimination.induced([[v, *self.dag.parents(v)] for v in self.nodes], order)[1]

    def max_marginal(self, variables: Sequence[str], evidence: dict[str, object] | None = None, order: str | Sequence[str] = "greedy") -> Factor:
        """The largest joint value for each state of the variables."""
        evidence = evidence or {}
        full = [f.reduce({v: s for v, s in evidence.items() if v in f.states}) for f in (c.to_factor() for c in self.cpds.values())]
        return self._eliminate(list(variables), full, order, F.max)

    def map_query(self, variables: Sequence[str] | None = None, evidence: dict[str, object] | None = None, virtual_evidence: Sequence[Factor] = (), order: str | Sequence[str] = "greedy") -> dict[str, object]:
        evidence = evidence or {}
        some = list(variables) if variables else [n for n in self.nodes if n not in evidence]
        return self.query(some, evidence, virtual_evidence, order).argmax()

    def get_state_probability(self, states: dict[str, object]) -> float:
        f = self._eliminate([], self._reduced([], states, ()), "greedy")
        return float(f.df.agg(F.sum(VALUE)).first()[0])

    def joint(self) -> JointDistribution:
        f = product(*[c.to_factor() for c in self.cpds.values()])
        return JointDistribution(f.df, f.variables, f.states)

    def is_imap(self, jpd: Factor, atol: float = 1e-8) -> bool:
        return self.joint().equals(jpd, atol)

    # --- many rows at once ---

    def posterior_table(self, evidence_rows: DataFrame, variables: Sequence[str]) -> Factor:
        """P(variables | row) for all evidence rows at once: the evidence columns are grouping keys that are never summed out, and
        only combinations that occur are listed. Rows with a null are left out."""
        given = evidence_rows.columns
        rows = evidence_rows.dropna().distinct()
        # the optimizer compares all expressions of wide rows with each other; a table has none
        rows = written(rows) if len(given) > WIDE else rows
        lead = Factor(rows.withColumn(VALUE, F.lit(1.0)), given, {g: self.states[g] for g in given}) if given else None
        keep = self.dag.ancestors({*variables, *given})
        factors = [self.cpds[n].to_factor() for n in self.nodes if n in keep]
        out = self._eliminate([*given, *variables], factors, "greedy", lead=lead)
        total = F.sum(VALUE).over(Window.partitionBy(*map(q, given)))
        return Factor(out.df.withColumn(VALUE, q(VALUE) / F.nullif(total, F.lit(0.0))), out.variables, out.states)

    def _by_missing(self, data: DataFrame, f: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        """``f(rows, given)`` for the rows of each pattern of nulls among the evidence columns, together: a missing value is summed out."""
        given = [c for c in data.columns if c in self.dag.pa]
        if not any(data.schema[c].nullable for c in given):
            return f(data, given)
        gone = F.concat_ws(",", *[F.when(q(c).isNull(), F.lit(str(i))) for i, c in enumerate(given)])
        patterns = sorted(r[0] for r in data.select(gone.alias("g")).distinct().collect())
        if patterns in ([], [""]):
            return f(data, given)
        out = [f(data.filter(gone == p), [c for i, c in enumerate(given) if str(i) not in p.split(",")]) for p in patterns]
        return functools.reduce(DataFrame.unionByName, out)

    def predict_probability(self, data: DataFrame) -> DataFrame:
        """``data`` with a column ``variable_state`` for each state of each missing variable: its posterior given the row. A null
        in an evidence column is summed out. Evidence of probability 0 gives nulls."""
        missing = [n for n in self.nodes if n not in data.columns]

        def one(part: DataFrame, given: list[str]) -> DataFrame:
            rows, out = part.select(*map(q, given)).distinct(), part
            for v in missing:
                post = self.posterior_table(rows, [v]).df
                wide = post.groupBy(*map(q, given)).agg(*[F.max(F.when(q(v) == F.lit(s), q(VALUE))).alias(f"{v}_{s}") for s in self.states[v]])
                out = joined_back(out, wide, given)
            return out.select(*map(q, data.columns), *[q(f"{v}_{s}") for v in missing for s in self.states[v]])

        return self._by_missing(data, one)

    def predict(self, data: DataFrame, stochastic: bool = False, seed: int = 0, key: str | None = None) -> DataFrame:
        """``data`` with its missing variables: the most likely joint assignment given each row (first in row-major order of
        ties), or a draw from the posterior. Each distinct evidence is worked out once and joined back. A null in an evidence
        column is summed out. Draws go by the column ``key``, by default by numbers that are written with the rows first."""
        missing = [n for n in self.nodes if n not in data.columns and n not in self.dag.latents]
        picked = F.struct(*map(q, missing))
        rows = numbered(data, key) if stochastic else data

        def one(part: DataFrame, given: list[str]) -> DataFrame:
            post = self.posterior_table(part.select(*map(q, given)).distinct(), missing)
            rank = Factor(post.df, missing, post.states).rank()
            if not stochastic:
                best = post.df.groupBy(*map(q, given)).agg(F.max_by(picked, F.struct(q(VALUE), *[-r for r in rank])).alias("_p"))
                out = joined_back(part, best, given)
                return out.select(*map(q, data.columns), *[F.col("_p")[m].alias(m) for m in missing])
            lists = post.df.groupBy(*map(q, given)).agg(F.sort_array(F.collect_list(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], q(VALUE).alias("p"), picked.alias("s")))).alias("_l"))
            out = joined_back(part, lists, given).withColumn("_u", uniform(q("_id"), seed))
            pick = F.aggregate("_l", F.struct(F.lit(0.0).alias("c"), F.lit(None).cast(post.df.select(picked.alias("s")).schema["s"].dataType).alias("s")), lambda a, x: F.struct((a["c"] + x["p"]).alias("c"), F.when((a["c"] <= q("_u")) & (x["p"] > 0), x["s"]).otherwise(a["s"]).alias("s")))["s"]
            return out.withColumn("_s", pick).select(*map(q, data.columns), *[F.col("_s")[m].alias(m) for m in missing])

        return self._by_missing(rows, one)

    def log_probability(self, data: DataFrame, column: str = "log_p") -> DataFrame:
        """``data`` with the log probability of each row: a join for each table, broadcast where it has at most a million rows."""
        out, parts = data, []
        for i, n in enumerate(self.nodes):
            c = self.cpds[n]
            own = c.df.withColumnRenamed(VALUE, f"_p{i}")
            out = out.join(F.broadcast(own) if math.prod(map(len, c.states.values())) <= 1_000_000 else own, c.variables, "left")
            parts.append(F.log(F.nullif(F.col(f"_p{i}"), F.lit(0.0))))
        total: Column = F.lit(0.0)
        for p in parts:
            total = total + F.coalesce(p, F.lit(-math.inf))
        return out.withColumn(column, total).select(*map(q, data.columns), column)

    def log_likelihood(self, data: DataFrame) -> float:
        return float(self.log_probability(data).agg(F.sum("log_p")).first()[0])

    # --- simulation ---

    def draw(self, df: DataFrame, c: CPD, seed: int, name: str) -> DataFrame:
        """``df`` with a draw of the table's variable given its parents' columns, by the inverse of its cumulated row. ``df`` has a key ``_id``."""
        states = c.states[c.variable]
        at = F.array_position(F.array(*[F.lit(s) for s in states]), q(c.variable))
        row = F.sort_array(F.collect_list(F.struct(at.alias("i"), q(VALUE).alias("p"))))
        lists = c.df.groupBy(*map(q, c.parents)).agg(row.alias("_row"))
        out = df.join(F.broadcast(lists), c.parents, "left") if c.parents else df.crossJoin(F.broadcast(lists))
        # at most one row for each parent configuration is broadcast
        cum = F.aggregate("_row", F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k")), lambda a, x: F.struct((a["c"] + x["p"]).alias("c"), (a["k"] + F.when(a["c"] + x["p"] <= q("_u"), 1).otherwise(0)).alias("k")))["k"]
        k = F.least(cum, F.lit(len(states) - 1)) + 1
        return out.withColumn("_u", uniform(F.col("_id"), seed)).withColumn(name, F.element_at(F.array(*[F.lit(s) for s in states]), k)).drop("_row", "_u")

    def sample(self, n: int, seed: int = 0, fixed: dict[str, object] | None = None, partial: DataFrame | None = None, include_latents: bool = True, key: str | None = None) -> DataFrame:
        """Forward sampling in topological order. ``partial``: rows whose columns are kept; ``fixed``: values that replace draws.
        Draws go by the column ``key`` of ``partial``, by default by numbers that are written with the rows first."""
        return self._sample(n, seed, fixed, partial, key).select(*[q(v) for v in self.nodes if include_latents or v not in self.dag.latents])

    def _sample(self, n: int, seed: int = 0, fixed: dict[str, object] | None = None, partial: DataFrame | None = None, key: str | None = None) -> DataFrame:
        spark = next(iter(self.cpds.values())).df.sparkSession
        have = set() if partial is None else set(partial.columns)
        out = spark.range(n).select(F.col("id").alias("_id")) if partial is None else numbered(partial, key)
        for i, v in enumerate(self.dag.topological()):
            if fixed and v in fixed:
                out = out.withColumn(v, F.lit(fixed[v]))
            elif v not in have:
                out = self.draw(out, self.cpds[v], seed + i, v)
        return out.select("_id", *map(q, self.nodes))

    def rejection_sample(self, n: int, evidence: dict[str, object], seed: int = 0) -> DataFrame:
        """Forward samples that agree with the evidence: as many rounds as it takes, each sized by the share kept of all rows
        so far, ten times as many while none was kept. Evidence of probability 0 raises, unless elimination is refused for
        its size: then the rounds don't end."""

        def agreeing(size: int, at: int) -> DataFrame:
            got = self._sample(size, at)
            for v, s in evidence.items():
                got = got.filter(q(v) == F.lit(s))
            return got

        return self._rounds(n, agreeing, seed, evidence).select(*map(q, self.nodes))

    def _rounds(self, n: int, accepted: Callable[[int, int], DataFrame], seed: int, evidence: dict[str, object], size_each: int | None = None) -> DataFrame:
        """The first ``n`` rows, by round and number, of ``accepted(size, seed)``, with ``_id``. Each round is written once it is drawn."""
        out, have, drawn, rounds = None, 0, 0, 0
        while have < n:
            size = size_each or (int(1.5 * (n - have) * drawn / have) + 1 if have else max(int(1.5 * n) + 1, 10 * drawn))
            got = written(accepted(size, seed + 1000 * rounds).withColumn("_round", F.lit(rounds)))
            kept = got.count()
            drawn, rounds = drawn + size, rounds + 1
            if have + kept > n:  # the numbers of the round's first rows; draws go by number, so their order says nothing about them
                got = got.withColumn("_h", uniform(q("_id"), seed + 17)).orderBy("_h", "_id").limit(n - have).drop("_h")
            out, have = (got if out is None else out.unionByName(got)), have + kept
            if rounds == 1 and not have and self._impossible(evidence):
                raise ValueError("the evidence has probability 0")
        if out is None:
            return accepted(0, seed)
        return out.withColumn("_id", q("_round").cast("long") * F.lit(1 << 40) + q("_id")).drop("_round")

    def approximate_map(self, variables: Sequence[str] | None = None, n: int = 10_000, evidence: dict[str, object] | None = None, samples: DataFrame | None = None, seed: int = 0, virtual_evidence: Sequence[Factor] = ()) -> dict[str, object]:
        """The most frequent states of the variables (by default of all without evidence) in samples; of ties the first in row-major order."""
        some = list(variables) if variables else [v for v in self.nodes if v not in (evidence or {})]
        return self.approximate(some, n, evidence, samples, seed, virtual_evidence).argmax()

    def _impossible(self, evidence: dict[str, object]) -> bool:
        try:
            return self.get_state_probability(evidence) == 0
        except ValueError:  # too large to eliminate
            return False

    def likelihood_weighted_sample(self, n: int, evidence: dict[str, object], seed: int = 0) -> DataFrame:
        """Samples with the evidence fixed and ``_weight``, its probability given each row's other values."""
        out = self.sample(n, seed, fixed=evidence).withColumn("_weight", F.lit(1.0))
        for v, s in evidence.items():
            c = self.cpds[v]
            row = c.df.filter(q(v) == F.lit(s)).drop(v).withColumnRenamed(VALUE, "_p")
            out = (out.join(row, c.parents, "left") if c.parents else out.crossJoin(row)).withColumn("_weight", q("_weight") * F.coalesce("_p", F.lit(0.0))).drop("_p")
        return out.select(*map(q, self.nodes), "_weight")

    def _conditioned(self, n: int, evidence: dict[str, object], do: dict[str, object], virtual: Sequence[Factor], partial: DataFrame | None, seed: int) -> DataFrame:
        """Samples given the evidence, with ``_id``: drawn from the joint posterior where it is small, else by rejection: rows that
        disagree go, and rows stay with a probability that grows with the virtual evidence's likelihood."""
        asked = [v for v in self.nodes if v not in evidence and v not in do]
        if partial is None and math.prod(len(self.states[v]) for v in asked) <= LOCAL_ROWS:
            out = self.query(asked, {**evidence, **do}, virtual).sample(n, seed, keep_id=True)
            for v, s in {**evidence, **do}.items():
                out = out.withColumn(v, F.lit(s))
            return out.select("_id", *map(q, self.nodes))

        def accepted(rows: DataFrame, at: int) -> DataFrame:
            for v, s in evidence.items():
                rows = rows.filter(q(v) == F.lit(s))
            for i, f in enumerate(virtual):
                v = f.variables[0]
                own = f.df.withColumn("_w", q(VALUE) / F.max(VALUE).over(Window.partitionBy())).select(q(v), "_w")
                rows = rows.join(F.broadcast(own), v).filter(uniform(q("_id"), at + 104_729 + i) < q("_w")).drop("_w")
            return rows.select("_id", *map(q, self.nodes))

        return self._rounds(n, lambda size, at: accepted(self._sample(size, at, do, partial), at), seed, {**evidence}, None if partial is None else partial.count())

    def simulate(self, n: int, do: dict[str, object] | None = None, evidence: dict[str, object] | None = None, virtual_evidence: Sequence[Factor] = (), virtual_intervention: Sequence[CPD] = (), partial: DataFrame | None = None, include_latents: bool = False, seed: int = 0, missing_prob: dict[str, float] | float | None = None) -> DataFrame:
        """Samples under interventions, evidence and missing values (each value goes missing with its column's probability)."""
        net = self.do([*(do or {}), *(c.variable for c in virtual_intervention)]) if do or virtual_intervention else self
        for c in virtual_intervention:
            net.cpds[c.variable] = CPD(c.df, c.variable, [], c.states)
        if evidence or virtual_evidence:
            out = net._conditioned(n, evidence or {}, do or {}, virtual_evidence, partial, seed)
        else:
            out = net._sample(n, seed, do, partial)
        keep = [v for v in self.nodes if include_latents or v not in self.dag.latents]
        gone = missing_prob if isinstance(missing_prob, dict) else dict.fromkeys(keep, missing_prob) if missing_prob else {}
        return out.select(*[F.when(uniform(F.col("_id"), seed + 7919 + i) < gone[v], None).otherwise(q(v)).alias(v) if v in gone else q(v) for i, v in enumerate(keep)])

    def approximate(self, variables: Sequence[str], n: int = 10_000, evidence: dict[str, object] | None = None, samples: DataFrame | None = None, seed: int = 0, virtual_evidence: Sequence[Factor] = ()) -> Factor:
        """Relative frequencies of the states in samples, on the full grid. ``virtual_evidence``: likelihoods over one variable
        each; samples stay with a probability that grows with them."""
        if samples is not None:
            rows = samples
        elif virtual_evidence:
            rows = self.simulate(n, evidence=evidence, virtual_evidence=virtual_evidence, include_latents=True, seed=seed)
        else:
            rows = self.rejection_sample(n, evidence, seed) if evidence else self.sample(n, seed)
        names = {v: self.states[v] for v in variables}
        counts = rows.groupBy(*map(q, variables)).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        full = grid(rows.sparkSession, list(variables), names).join(counts, list(variables), "left")
        return Factor(full.select(*map(q, variables), F.coalesce("_n", F.lit(0.0)).alias(VALUE)), list(variables), names).normalize()


# --- expectation maximisation -------------------------------------------------------------------------------------


def expectation_maximization(net: BayesianNetwork, data: DataFrame, latent_states: dict[str, list], rounds: int = 100, atol: float = 1e-8, seed: int = 0) -> BayesianNetwork:
    """Tables of a network with latent nodes. Distinct rows are expanded once by the latent states; each round weighs the
    expansion by the current tables and counts the families. Tables are small and come to the driver between rounds, so the
    plan of a round never grows."""
    seen = [v for v in net.nodes if v not in latent_states]
    states = state_names(data, seen) | latent_states
    spark = data.sparkSession
    touched = [v for v in net.nodes if v in latent_states or any(p in latent_states for p in net.dag.pa[v])]
    out = BayesianNetwork(net.edges, net.nodes, net.dag.latents)
    for i, v in enumerate(net.nodes):
        parents = net.dag.parents(v)
        own = {n: states[n] for n in (v, *parents)}
        out.cpds[v] = CPD.random(spark, v, parents, own, seed + i) if v in touched else mle_cpd(data, v, parents, own)
    rows = data.dropna(subset=seen).groupBy(*map(q, seen)).agg(F.count(F.lit(1)).alias("_n")).crossJoin(grid(spark, list(latent_states), latent_states)).persist()
    try:
        for _ in range(rounds):
            weighed: DataFrame = rows.withColumn("_w", F.lit(1.0))
            for i, v in enumerate(touched):
                c = out.cpds[v]
                weighed = weighed.join(F.broadcast(c.df.withColumnRenamed(VALUE, f"_p{i}")), c.variables).withColumn("_w", q("_w") * F.greatest(F.col(f"_p{i}"), F.lit(1e-10))).drop(f"_p{i}")
            share = q("_w") / F.sum("_w").over(Window.partitionBy(*map(q, seen)))
            weighed = weighed.withColumn("_w", share * q("_n"))
            worst = 0.0
            # one scan for all families
            families = [[v, *net.dag.parents(v)] for v in touched]
            names = sorted({n for f in families for n in f})
            sets = weighed.groupingSets([[q(n) for n in f] for f in families], *map(q, names)).agg(F.sum("_w").alias("n"), F.grouping_id().alias("g")).collect()
            for v, family in zip(touched, families, strict=True):
                mask = sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in family)
                own = {n: states[n] for n in family}
                table = np.zeros([len(own[n]) for n in family])
                for r in sets:
                    if r["g"] == mask:
                        table[tuple(own[n].index(r[n]) for n in family)] += r["n"]
                table = table.reshape(len(own[v]), -1)
                total = table.sum(0)
                table = np.where(total > 0, table / np.where(total > 0, total, 1), 1 / len(table))
                worst = max(worst, float(np.abs(table - out.cpds[v].rows()).max()))
                out.cpds[v] = CPD.table(spark, v, table, family[1:], own)
            if worst <= atol:
                break
    finally:
        rows.unpersist()
    return out


def naive_bayes(data: DataFrame, target: str, features: Sequence[str] | None = None) -> BayesianNetwork:
    """The features depend on the target only."""
    return BayesianNetwork([(target, f) for f in (features or [c for c in data.columns if c != target])], [target]).fit(data)

