import math

import numpy as np
import pytest

from credalis.functions.special import chi2_tail, f_tail, lgamma, t_tail
from credalis.operators import causal, metrics, structure
from credalis.operators.citests import CITests, GaussianTests, IndependenceMatch, mutual_information, pillai_trace, power_divergence
from credalis.operators.factors import CPD
from credalis.operators.gaussian import GaussianDistribution, Gram, LinearGaussianCPD, LinearGaussianNetwork, two_stage_least_squares
from credalis.operators.network import BayesianNetwork
from credalis.operators.scores import GaussianScore, Score, local_score
from credalis.plans.graph import DAG, PDAG, Assertion, Independencies


# These rows, and the scores below, must match.
@pytest.fixture(scope="module")
def d1(spark):
    return spark.createDataFrame([(0, 0, 1, "X"), (0, 1, 1, "Y"), (1, 0, 0, "Z")], "A int, B int, C int, D string")


def test_scores_of_small_data(d1):
    m1 = DAG([("A", "C"), ("B", "C"), ("D", "B")])
    m2 = DAG([("C", "A"), ("C", "B"), ("A", "D")])
    want = {"k2": (-10.73813429536977, -10.345091707260167), "bdeu": (-9.907103407446435, -9.839964104608821), "bic": (-10.698440814229318, -9.625886526130714), "aic": (-15.205379370888767, -13.68213122712422)}
    for name, (a, b) in want.items():
        s = Score(d1, name)
        assert s.score(m1) == pytest.approx(a) and s.score(m2) == pytest.approx(b)
        assert local_score(d1, "C", ["A", "B"], name).first()[0] == pytest.approx(s.local("C", ["A", "B"]))


def test_special_functions(spark):
    got = spark.createDataFrame([(0.001,), (0.5,), (3.7,), (7.999,), (8.0,), (150.25,), (1e6,)], "x double").select("x", lgamma(__import__("pyspark").sql.functions.col("x")).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and t_tail(2.228138852, 10) == pytest.approx(0.05, rel=1e-6) and f_tail(4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)


def planted(spark, n=6000, seed=4):
    net = BayesianNetwork([("A", "C"), ("B", "C"), ("C", "D")])
    net.add_cpds(
        CPD.table(spark, "A", [[0.5], [0.5]]),
        CPD.table(spark, "B", [[0.4], [0.6]]),
        CPD.table(spark, "C", [[0.9, 0.3, 0.2, 0.1], [0.1, 0.7, 0.8, 0.9]], ["A", "B"], cards=[2, 2]),
        CPD.table(spark, "D", [[0.85, 0.15], [0.15, 0.85]], ["C"], cards=[2]),
    )
    return net, spark.createDataFrame([tuple(r) for r in net.sample(n, seed).select("A", "B", "C", "D").collect()], "A int, B int, C int, D int").persist()


def test_search_recovers_a_planted_graph(spark):
    net, data = planted(spark)
    s = Score(data, "bic")
    dag = structure.hill_climb(s, data.columns)
    # greedy steps may end in a local optimum with an edge too many
    assert dag.skeleton() >= net.dag.skeleton() and len(dag.edges) <= 4
    assert s.jobs <= 8  # steps, not candidates
    assert structure.greedy_equivalence(Score(data, "bic"), data.columns).skeleton() >= net.dag.skeleton()
    assert structure.exhaustive(s, data.columns)[-1][1].is_iequivalent(net.dag)
    tests = CITests(data)
    assert structure.pc(tests, data.columns).is_iequivalent(net.dag)
    assert structure.mmhc(data, Score(data, "bic")).skeleton() == net.dag.skeleton()
    assert structure.chow_liu(data, root="A").has_edge("C", "D")
    assert structure.tan(data, "C").parents("D")[-1] == "C" or "C" in structure.tan(data, "C").parents("D")
    assert metrics.fisher_c(net.dag, tests) > 0.01 and metrics.correlation_score(net.dag, tests) > 0.7
    assert {(u, v) for u, v, *_ in metrics.implied_cis(net.dag, tests)} == {("A", "B"), ("A", "D"), ("B", "D")}
    x, p, dof = tests.test("A", "D", ["C"])
    r = power_divergence(data, "A", "D", ["C"]).first()
    assert r.statistic == pytest.approx(x) and r.dof == dof
    for lam in ("log-likelihood", "cressie-read", "freeman-tukey"):
        assert power_divergence(data, "A", "C", [], lam).first()[0] == pytest.approx(CITests(data, lam).test("A", "C")[0])
    assert mutual_information(data, "A", "C").first()[0] == pytest.approx(structure.weights(data, ["A", "C"])["A", "C"])


def test_pc_from_statements():
    facts = Independencies(("B", "C"), ("B", "D"), ("C", "D"), ("A", "B", "C"), ("A", "C", "B"))
    g, apart = structure.pc(IndependenceMatch(facts), ["A", "B", "C", "D"], return_type="skeleton")
    assert {frozenset(e) for e in g.edges} == {frozenset(("A", "D"))}
    assert apart[frozenset(("A", "C"))] == frozenset({"B"})


def test_graphs():
    d = DAG([("A", "C"), ("B", "C"), ("C", "D"), ("B", "D")])
    assert d.minimal_dseparator("A", "D") == {"B", "C"} and d.minimal_dseparator("A", "C") is None
    assert d.markov_blanket("A") == ["B", "C"] and d.moralize().is_triangulated()
    assert Independencies(("X", {"Y", "Z"})).entails(Independencies(("X", "Y", "Z")))
    assert not Independencies(("X", "Y")).entails(Independencies(("X", "Y", "Z")))
    assert Assertion("X", "Y", "Z") == Assertion("Y", "X", "Z")
    assert PDAG([("A", "B")], [("B", "C")]).oriented().directed == {("A", "B"), ("B", "C")}
    with pytest.raises(ValueError):
        DAG([("A", "B"), ("B", "A")])
    assert metrics.shd(DAG([("A", "B")]), DAG([("B", "A")])) == 1


def test_causal_queries(spark):
    t = lambda v, rows, parents=(): CPD.table(spark, v, rows, parents, cards=[2] * len(parents))
    # This network must match.
    net = BayesianNetwork([("S", "T"), ("T", "C"), ("S", "C")]).add_cpds(t("S", [[0.5], [0.5]]), t("T", [[0.25, 0.75], [0.75, 0.25]], ["S"]), t("C", [[0.3, 0.4, 0.7, 0.8], [0.7, 0.6, 0.3, 0.2]], ["S", "T"]))
    np.testing.assert_allclose(net.query(["C"], {"T": 1}).values(), [0.5, 0.5])
    np.testing.assert_allclose(causal.do_query(net, ["C"], {"T": 1}).values(), [0.6, 0.4])
    np.testing.assert_allclose(causal.do_query(net, ["C"], {"T": 0}).values(), [0.5, 0.5])
    assert causal.backdoor_sets(net.dag, "T", "C") == [frozenset({"S"})]
    front = DAG([("U", "X"), ("U", "Y"), ("X", "M"), ("M", "Y")], latents=["U"])
    assert causal.frontdoor_sets(front, "X", "Y") == [frozenset({"M"})] and causal.backdoor_sets(front, "X", "Y") == []
    assert causal.is_valid_adjustment_set(net.dag, ["T"], ["C"], {"S"}) and not causal.is_valid_adjustment_set(net.dag, ["T"], ["C"], set())
    iv = DAG([("Z", "X"), ("U", "X"), ("U", "Y"), ("X", "Y")], latents=["U"])
    assert causal.instruments(iv, "X", "Y") == {"Z"}


def test_gaussian(spark):
    rng = np.random.default_rng(1)
    u, z = rng.normal(size=4000), rng.normal(size=4000)
    x = 2 * z + u + rng.normal(size=4000) * 0.1
    y = 1.5 * x - 3 * u + 5
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), z.tolist())), "x double, y double, z double")
    assert two_stage_least_squares(d, "x", "y", ["z"]) == pytest.approx(1.5, abs=0.08)
    g = Gram.of(d)
    np.testing.assert_allclose(g.cov(), np.cov([x, y, z]), rtol=1e-9)
    assert g.partial_correlation("x", "y", ["z"], center=True) == pytest.approx(np.corrcoef(x - np.polyval(np.polyfit(z, x, 1), z), y - np.polyval(np.polyfit(z, y, 1), z))[0, 1])
    assert GaussianTests(d).test("x", "z")[1] < 1e-9 and pillai_trace(d, "x", "z")[1] < 1e-9
    net = LinearGaussianNetwork([("x1", "x2"), ("x2", "x3")])
    net.cpds = {"x1": LinearGaussianCPD("x1", 1, [], 4, []), "x2": LinearGaussianCPD("x2", -5, [0.5], 4, ["x1"]), "x3": LinearGaussianCPD("x3", 4, [-1], 3, ["x2"])}
    j = net.joint()
    np.testing.assert_allclose(j.mean, [1, -4.5, 8.5])
    np.testing.assert_allclose(j.cov, [[4, 2, -2], [2, 5, -5], [-2, -5, 8]])
    s = net.simulate(spark, 20_000, seed=1)
    fit = LinearGaussianNetwork([("x1", "x2"), ("x2", "x3")]).fit(s)
    assert fit.cpds["x2"].slopes[0] == pytest.approx(0.5, abs=0.05) and fit.cpds["x3"].variance == pytest.approx(3, abs=0.15)
    pred = net.predict(spark.createDataFrame([(2.0, -3.0)], "x1 double, x2 double")).first()
    assert pred.x3 == pytest.approx(7)
    a, b = GaussianDistribution(["x", "y"], [1, 2], [[2, 0.5], [0.5, 1]]), GaussianDistribution(["y"], [0], [[3]])
    assert a.product(b).divide(b).equals(a)
    assert a.to_canonical().marginalize(["y"]).to_gaussian().equals(a.marginalize(["y"]))
    assert a.to_canonical().marginalize(["y"]).pdf(0.3) == pytest.approx(a.marginalize(["y"]).pdf(0.3))
    assert GaussianScore(s).local("x3", ["x2"]) > GaussianScore(s).local("x3", [])


def test_correlation_score_counts_independence_as_positive():
    """Three of six pairs d-separated, four found independent, two of them rightly."""
    dag = DAG([("a", "b"), ("c", "b"), ("b", "d")])  # d-separated: a, c only
    facts = {("a", "c"), ("a", "d"), ("c", "d")}

    class Fixed:
        def prefetch(self, tests):
            """Nothing to count."""

        def independent(self, x, y, z=(), level=0.05):
            return tuple(sorted((x, y))) in facts

    assert metrics.correlation_score(dag, Fixed()) == pytest.approx(2 * 1 / (3 + 1))
    rows = metrics.correlation_score(dag, Fixed(), summary=True)
    assert len(rows) == 6 and sum(r[2] for r in rows) == 3 and sum(r[3] for r in rows) == 1
    assert metrics.correlation_score(dag, Fixed(), score=lambda t, p: sum(a == b for a, b in zip(t, p)) / len(t)) == pytest.approx(4 / 6)


def test_gram_matrix_keeps_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    data = spark.createDataFrame([(float(a + 1e9), float(a + b - 1e8)) for a, b in x], "u double, v double")
    want = np.cov(np.array([(r.u, r.v) for r in data.collect()]).T)
    np.testing.assert_allclose(Gram.of(data).cov(), want, rtol=1e-6)
