import numpy as np
import pytest

from credalis.operators.factors import CPD, Factor, JointDistribution, sum_product
from credalis.functions.density import density_column
from credalis.functions.kinds import kinds, prepared
from credalis.operators import network
from credalis.operators.network import BayesianNetwork, expectation_maximization, mle_cpd, naive_bayes
from credalis.plans import elimination


# This network and the results of its queries below must match.
def student(spark):
    net = BayesianNetwork([("A", "J"), ("R", "J"), ("J", "Q"), ("J", "L"), ("G", "L")])
    t = lambda v, rows, parents=(): CPD.table(spark, v, rows, parents, cards=[2] * len(parents))
    return net.add_cpds(
        t("A", [[0.2], [0.8]]),
        t("R", [[0.4], [0.6]]),
        t("G", [[0.6], [0.4]]),
        t("J", [[0.9, 0.6, 0.7, 0.1], [0.1, 0.4, 0.3, 0.9]], ["A", "R"]),
        t("Q", [[0.9, 0.2], [0.1, 0.8]], ["J"]),
        t("L", [[0.9, 0.45, 0.8, 0.1], [0.1, 0.55, 0.2, 0.9]], ["J", "G"]),
    )


def test_queries(spark):
    net = student(spark)
    assert net.check_model()
    np.testing.assert_allclose(net.query(["J"]).values(), [0.416, 0.584])
    np.testing.assert_allclose(net.query(["J", "Q"]).values(), [[0.3744, 0.0416], [0.1168, 0.4672]])
    np.testing.assert_allclose(net.query(["J"], {"A": 0, "R": 1}).values(), [0.6, 0.4])
    np.testing.assert_allclose(net.query(["J", "Q"], {"A": 0, "R": 0, "G": 0, "L": 1}).values(), [[0.73636364, 0.08181818], [0.03636364, 0.14545455]])
    assert net.map_query(["J", "Q"]) == {"J": 1, "Q": 1}
    assert net.get_state_probability({"A": 0, "R": 1}) == pytest.approx(0.12)


def test_orders_and_virtual_evidence_agree(spark):
    net = student(spark)
    like = Factor.of(spark, ["J"], [0.3, 0.9], cards=[2])
    want = net.joint().product(like).marginalize(["A", "R", "G", "J", "L"]).normalize().values()
    for order in ("MinFill", "MinNeighbors", "MinWeight", "WeightedMinFill", "greedy"):
        np.testing.assert_allclose(net.query(["Q"], virtual_evidence=[like], order=order).values(), want)


def test_pruning_keeps_what_a_query_needs(spark):
    net = student(spark)
    assert elimination.requisite(net.dag, ["Q"], ["J"]) == {"Q"}
    assert elimination.requisite(net.dag, ["A"], []) == {"A"}
    assert elimination.requisite(net.dag, ["A"], ["L"]) == {"A", "R", "J", "G", "L"}
    joint = net.joint()
    for asked, given in ((["Q"], {"J": 1}), (["A"], {"L": 0, "G": 1}), (["G"], {"L": 1, "Q": 0}), (["R", "Q"], {"J": 0})):
        want = joint.reduce(given).marginalize([v for v in net.nodes if v not in asked and v not in given]).normalize()
        assert net.query(asked, given).equals(want)


def test_factor_algebra(spark):
    a = Factor.of(spark, ["x", "y"], [1, 2, 0, 4], cards=[2, 2])
    b = Factor.of(spark, ["y"], [0, 2], cards=[2])
    np.testing.assert_allclose(a.product(b).values(), [[0, 4], [0, 8]])
    np.testing.assert_allclose(a.divide(b).values(), [[np.inf, 1], [0, 2]])
    np.testing.assert_allclose(a.plus(b).values(), [[1, 4], [0, 6]])
    np.testing.assert_allclose(a.marginalize(["x"]).values(), [1, 6])
    np.testing.assert_allclose(a.maximize(["y"]).values(), [2, 4])
    np.testing.assert_allclose(sum_product(["x"], [a, b]).values(), [4, 8])
    assert a.argmax() == {"x": 1, "y": 1} and a.get_value(x=0, y=1) == 2 and a.set_value(9, x=0, y=1).get_value(x=0, y=1) == 9
    assert a.assignment([0, 3]) == [[("x", 0), ("y", 0)], [("x", 1), ("y", 1)]]
    assert a.equals(Factor.of(spark, ["y", "x"], [1, 0, 2, 4], cards=[2, 2])) and not a.equals(a.product(2.0))
    j = JointDistribution.of(spark, ["x", "y"], [0.1, 0.3, 0.15, 0.45], cards=[2, 2])
    assert j.check_independence(["x"], ["y"])
    np.testing.assert_allclose(j.conditional_distribution({"x": 0}).values(), [0.25, 0.75])
    assert j.independencies() == [("x", "y")]
    assert j.minimal_imap(["x", "y"]).edges == []


def test_fit_predict_and_update(spark):
    # The three rows and the tables they give must match.
    d = spark.createDataFrame([(0, 0, 1, "X"), (0, 1, 1, "Y"), (1, 0, 0, "Z")], "A int, B int, C int, D string")
    np.testing.assert_allclose(mle_cpd(d, "C", ["A", "B"]).rows(), [[0, 0, 1, 0.5], [1, 1, 0, 0.5]])
    net = BayesianNetwork([("A", "C"), ("B", "C")]).fit(d)
    np.testing.assert_allclose(net.cpds["A"].rows().ravel(), [2 / 3, 1 / 3])
    assert [r["C"] for r in net.predict(d.select("A", "B")).orderBy("A", "B").collect()] == [1, 1, 0]
    p = net.predict_probability(d.select("A", "B")).orderBy("A", "B").collect()
    assert [(r["C_0"], r["C_1"]) for r in p] == [(0, 1), (0, 1), (1, 0)]
    assert net.log_likelihood(d) == pytest.approx(sum(np.log([2 / 3, 2 / 3, 1 / 3, 2 / 3, 1 / 3, 2 / 3])))
    k2 = BayesianNetwork([("A", "C"), ("B", "C")]).fit(d, prior="K2").cpds["C"].rows()
    np.testing.assert_allclose(k2, [[1 / 3, 1 / 3, 2 / 3, 0.5], [2 / 3, 2 / 3, 1 / 3, 0.5]])
    net.fit_update(d, 3)
    np.testing.assert_allclose(net.cpds["A"].rows().ravel(), [2 / 3, 1 / 3])


def test_samples_follow_the_tables(spark):
    net = student(spark)
    s = net.sample(20_000, seed=3)
    assert abs(s.filter("J = 1").count() / 20_000 - 0.584) < 0.015
    w = net.likelihood_weighted_sample(20_000, {"Q": 1}, seed=5).selectExpr("sum(_weight * J) / sum(_weight)").first()[0]
    assert abs(w - net.query(["J"], {"Q": 1}).values()[1]) < 0.02
    r = net.rejection_sample(500, {"A": 0}, seed=1)
    assert r.count() == 500 and r.filter("A <> 0").isEmpty()
    do = net.simulate(4000, do={"J": 0}, seed=2)
    assert abs(do.filter("Q = 0").count() / 4000 - 0.9) < 0.03


def test_rejection_reaches_unlikely_evidence(spark):
    net = BayesianNetwork([("A", "B")]).add_cpds(CPD.table(spark, "A", [[1 - 2e-5], [2e-5]]), CPD.table(spark, "B", [[1, 0.5], [0, 0.5]], ["A"], cards=[2]))
    got = net.rejection_sample(3, {"B": 1}, seed=1)
    assert got.count() == 3 and got.filter("A = 0 or B = 0").isEmpty()
    with pytest.raises(ValueError):
        net.rejection_sample(1, {"A": 0, "B": 1})


def test_em_recovers_a_latent_class(spark):
    rng = np.random.default_rng(0)
    z = rng.random(3000) < 0.5
    cols = [np.where(rng.random(3000) < 0.9, z, ~z).astype(int).tolist() for _ in range(3)]
    d = spark.createDataFrame(list(zip(*cols)), "a int, b int, c int")
    net = expectation_maximization(BayesianNetwork([("Z", "a"), ("Z", "b"), ("Z", "c")], latents=["Z"]), d, {"Z": [0, 1]}, rounds=25, atol=1e-4)
    assert np.allclose(sorted(net.cpds["a"].rows()[0]), [0.1, 0.9], atol=0.06)


def test_prediction_sums_out_missing_evidence_and_takes_wide_rows(spark):
    net = student(spark)
    rows = spark.createDataFrame([(0, 1), (None, 1), (0, None), (None, None)], "L int, G int")
    got = {(r.L, r.G): r for r in net.predict_probability(rows).collect()}
    for (left, grade), r in got.items():
        want = net.query(["J"], {k: v for k, v in (("L", left), ("G", grade)) if v is not None}).values()
        np.testing.assert_allclose([r.J_0, r.J_1], want)
    best = {(r.L, r.G): r.J for r in net.predict(rows).collect()}
    assert len(best) == 4 and best[0, 1] == net.map_query(["A", "R", "J", "Q"], {"L": 0, "G": 1})["J"]
    rng = np.random.default_rng(0)
    c = rng.integers(0, 2, 400)
    data = spark.createDataFrame([(int(k), *map(int, (rng.random(30) < (0.3 + 0.4 * k)))) for k in c], "c int, " + ", ".join(f"e{i} int" for i in range(30)))
    out = naive_bayes(data, "c").predict(data.drop("c"))
    assert out.count() == 400 and out.filter("c is null").count() == 0
    a, b = sorted(map(str, net.predict(rows, stochastic=True, seed=3).collect())), sorted(map(str, net.predict(rows, stochastic=True, seed=3).collect()))
    assert a == b


def test_conditioned_samples_of_large_networks(spark, monkeypatch):
    net = student(spark)
    like = Factor.of(spark, ["Q"], [1.0, 0.25], cards=[2])
    want = net.query(["J"], {"L": 1}, [like]).values()
    for rows in (100_000, 1):  # from the joint posterior, and by rejection
        monkeypatch.setattr(network, "LOCAL_ROWS", rows)
        got = net.simulate(4000, evidence={"L": 1}, virtual_evidence=[like], seed=5)
        assert got.count() == 4000 and got.filter("L = 0").count() == 0
        assert got.filter("J = 1").count() / 4000 == pytest.approx(want[1], abs=0.03)
    assert net.approximate(["J"], 4000, {"L": 1}, seed=2, virtual_evidence=[like]).values()[1] == pytest.approx(want[1], abs=0.03)
    assert net.approximate_map(["J"], 4000, {"L": 1}, seed=2) == net.map_query(["J"], {"L": 1})
    partial = spark.createDataFrame([(0,), (1,)] * 50, "A int")
    draws = net.sample(0, seed=1, partial=partial)
    assert draws.count() == 100 and draws.filter("A = 0").count() == 50


def test_strategies_and_small_tools(spark):
    net = student(spark)
    graph = elimination.scope_graph([[v, *net.dag.parents(v)] for v in net.nodes] + [["A", "Q"], ["Q", "G"]])
    cards = {v: 2 + i % 3 for i, v in enumerate(sorted(net.nodes))}
    for h in ("H1", "H2", "H3", "H4", "H5", "H6"):
        filled = elimination.triangulated(graph, cards, h)
        assert filled.is_triangulated() and all(v in filled.near[u] for u in graph.near for v in graph.near[u])
    assert net.induced_width(["Q", "A", "R", "L", "G", "J"]) == 2 and net.induced_width(["J", "A", "R", "Q", "G", "L"]) == 5
    a = Factor.of(spark, ["x", "y"], [1, 2, 0, 4], cards=[2, 2])
    b = Factor.of(spark, ["y", "x"], [1, 0, 2, 4], cards=[2, 2])
    assert a.fingerprint() == b.fingerprint() != a.product(2.0).fingerprint()
    assert a.text(1).splitlines()[3] == "| 0 | 0 | 1.0   |"
    data = spark.createDataFrame([(0, "u", 1.5, True), (1, None, None, False)], "i int, s string, d double, b boolean")
    frame, found = prepared(data, ordered=["s"])
    assert found == {"i": "N", "s": "O", "d": "N", "b": "C"} and dict(frame.dtypes)["i"] == "double"
    with pytest.raises(ValueError):
        kinds(spark.range(1).selectExpr("array(id) AS a"))
    got = data.select(density_column(lambda i, d: i + d, data["i"], data["d"]).alias("p"), density_column(np.exp, data["d"], vectorized=True).alias("e")).collect()
    assert [r.p for r in got] == [1.5, None] and got[0].e == pytest.approx(np.exp(1.5))
    own = BayesianNetwork([("A", "B")]).fit(data, estimator=lambda n, d: [CPD.table(spark, "A", [[0.5], [0.5]]), CPD.table(spark, "B", [[1, 0], [0, 1]], ["A"], cards=[2])])
    np.testing.assert_allclose(own.query(["B"]).values(), [0.5, 0.5])
