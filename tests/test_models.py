import numpy as np
import pytest

from credalis.operators import mcmc
from credalis.operators.factors import CPD, Factor
from credalis.operators.markov import FactorGraph, MarkovNetwork, Mplp, mirror_descent
from credalis.operators.sem import SemEstimator, StructuralModel
from credalis.operators.sequences import DynamicNetwork, MarkovChain
from tests.test_network import student


def test_messages_agree_with_elimination(spark):
    net = student(spark)
    want = net.query(["Q"], {"L": 0}).values()
    tree = MarkovNetwork.of(net).junction_tree()
    np.testing.assert_allclose(tree.query(["Q"], {"L": 0}).values(), want)
    np.testing.assert_allclose(tree.query(["A", "G"]).values(), net.query(["A", "G"]).values())
    np.testing.assert_allclose(FactorGraph([c.to_factor() for c in net.cpds.values()]).propagate(["Q"], {"L": 0})["Q"].values(), want)
    assert MarkovNetwork.of(net).partition_function() == pytest.approx(1)


def test_mplp_finds_the_best_assignment(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    fs = [Factor.of(spark, [n], np.exp(rng.normal(size=2)), cards=[2]) for n in names]
    fs += [Factor.of(spark, [u, v], np.exp(rng.normal(size=4) * 2), cards=[2, 2]) for u, v in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"))]
    net = MarkovNetwork(fs)
    m = Mplp(net)
    best = m.map_query()
    joint = np.zeros((2,) * 4)
    for f in fs:
        at = [names.index(v) for v in f.variables]
        joint = joint + np.log(f.values()).reshape([2 if i in at else 1 for i in range(4)])
    assert tuple(best[n] for n in names) == np.unravel_index(joint.argmax(), joint.shape) and m.integrality_gap() < 1e-3


def test_mirror_descent_fits_marginals(spark):
    rng = np.random.default_rng(0)
    p = rng.random((2, 3, 2))
    p /= p.sum()
    theta, loss = mirror_descent(spark, {("a", "b"): p.sum(2), ("b", "c"): p.sum(0)}, {"a": [0, 1], "b": [0, 1, 2], "c": [0, 1]}, rounds=2000)
    assert loss < 1e-6


def test_dynamic_networks(spark):
    t = lambda v, rows, parents=(): CPD.table(spark, v, rows, parents, cards=[2] * len(parents))
    # Both networks and their results must match.
    one = DynamicNetwork([("Z", "X"), ("Z", "Y")], [("Z", "Z")]).set_tables([t("Z_0", [[0.8], [0.2]]), t("X_0", [[0.9, 0.6], [0.1, 0.4]], ["Z_0"]), t("Y_0", [[0.7, 0.2], [0.3, 0.8]], ["Z_0"])], [t("Z_1", [[0.9, 0.1], [0.1, 0.9]], ["Z_0"])])
    np.testing.assert_allclose(one.forward(["X_0"])["X_0"].values(), [0.84, 0.16])
    np.testing.assert_allclose(one.query(["Z_1"], {"Y_0": 0, "Y_1": 0})["Z_1"].values(), [0.95080214, 0.04919786], atol=1e-7)
    two = DynamicNetwork([("Z", "X"), ("X", "Y")], [("Z", "Z")]).set_tables([t("Z_0", [[0.5], [0.5]]), t("X_0", [[0.6, 0.9], [0.4, 0.1]], ["Z_0"]), t("Y_0", [[0.2, 0.3], [0.8, 0.7]], ["X_0"])], [t("Z_1", [[0.4, 0.7], [0.6, 0.3]], ["Z_0"])])
    np.testing.assert_allclose(two.query(["X_2"], {"Y_0": 1, "Y_1": 0, "Y_2": 1})["X_2"].values(), [0.76738736, 0.23261264], atol=1e-7)


def test_chains(spark):
    chain = MarkovChain({"w": np.array([[0.9, 0.1], [0.5, 0.5]])})
    np.testing.assert_allclose(chain.stationary("w"), [5 / 6, 1 / 6])
    s = chain.sample(spark, 2000, chains=4, seed=1)
    assert s.count() == 8000 and abs(s.filter("w = 0").count() / 8000 - 5 / 6) < 0.04
    f = [Factor.of(spark, ["x", "y"], [4, 1, 1, 4], cards=[2, 2]), Factor.of(spark, ["x"], [1, 3], cards=[2])]
    g = mcmc.gibbs(spark, f, 1500, chains=4, seed=2)
    assert abs(g.filter("x = 1").count() / 6000 - 0.75) < 0.05 and abs(g.filter("x = y").count() / 6000 - 0.8) < 0.05
    d = mcmc.gaussian_density([1, -1], [[1, 0.6], [0.6, 2]])
    for draw in (mcmc.hmc(spark, d, ["a", "b"], 600, chains=4, adapt=150, seed=3), mcmc.nuts(spark, d, ["a", "b"], 500, chains=4, adapt=150, seed=4)):
        r = draw.selectExpr("avg(a)", "avg(b)", "var_samp(b)", "covar_samp(a, b)").first()
        np.testing.assert_allclose(list(r), [1, -1, 2, 0.6], atol=0.3)


def test_structural_equations(spark):
    m = StructuralModel.parse("f =~ y1 + y2 + y3\nf ~ x  # cause\ny1 ~~ y2")
    assert m.latents == {"f"} and m.paths["f", "y1"] == 1.0 and ("y1", "y2") in m.covariances
    m = StructuralModel.parse("f =~ y1 + y2 + y3 + y4\nf ~ x")
    theta = np.array([0.8, 1.3, 0.5, 0.7] + [0.6] * (len(m.parameters()) - 4))
    data = m.simulate(spark, theta, 20_000, seed=1)
    for method in ("ML", "GLS", "ULS"):
        got, stats = SemEstimator(m, method).fit(data)
        assert np.allclose([got[k] for k in m.parameters()], theta, atol=0.12), (method, got)
    assert stats["srmr"] < 0.02 and stats["dof"] == 5
