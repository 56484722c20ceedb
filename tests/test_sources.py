import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalis.functions import density
from credalis.functions.discretize import equal_frequency, equal_width
from credalis.functions.special import normal_cdf
from credalis.operators.factors import Factor
from credalis.operators.markov import MarkovNetwork
from credalis.sources import models
from credalis.streaming import online
from tests.test_network import student

BIF = """// made by hand
network test { }
variable rain { type discrete [ 2 ] { yes, no }; property position = (1, 2) ; }
variable wet { type discrete [ 3 ] { dry, damp, wet }; }
probability ( rain ) { table 0.2, 8e-1; }
probability ( wet | rain ) { default 0.1, 0.2, 0.7; (no) 0.7, 0.2, 0.1; }
"""


def test_bif_details():
    s = models.read_bif(BIF)
    assert s.states == {"rain": ["yes", "no"], "wet": ["dry", "damp", "wet"]} and s.properties["rain"] == {"position ": " (1, 2)"}
    np.testing.assert_allclose(s.tables["wet"][1], [[0.1, 0.7], [0.2, 0.2], [0.7, 0.1]])


@pytest.mark.parametrize("kind", ["bif", "xmlbif", "net", "xbn"])
def test_files_round_trip(spark, tmp_path, kind):
    net = student(spark)
    path = f"{tmp_path}/m.{kind}"
    models.save(net, path)
    back = models.load(spark, path)
    assert set(back.edges) == set(net.edges)
    for v in net.nodes:
        other = back.cpds[v].reorder_parents(net.cpds[v].parents)
        np.testing.assert_allclose(other.rows(), net.cpds[v].rows())


def test_parquet_and_uai_round_trip(spark, tmp_path):
    net = student(spark)
    models.save(net, f"{tmp_path}/m.parquet")
    back = models.load(spark, f"{tmp_path}/m.parquet")
    np.testing.assert_allclose(back.cpds["L"].rows(), net.cpds["L"].rows())
    spec = models.read_uai("MARKOV\n3\n2 2 3\n2\n2 0 1\n2 1 2\n\n4\n 4.0 2.4e0 1.0 0\n\n6\n2.25 3.25 3.75 0.00 0.00 10.0\n")
    assert spec.factors[1][0] == ["var_1", "var_2"] and spec.factors[0][1][0, 1] == 2.4
    again = models.read_uai(models.write_uai(spec))
    np.testing.assert_allclose(again.factors[1][1], spec.factors[1][1])
    bayes = models.read_uai(models.write_uai(models.Spec.of(net)))
    assert bayes.tables["var_1"][1].shape == (2, 1) and len(bayes.tables) == 6
    assert isinstance(spec.markov(spark), MarkovNetwork) and isinstance(spec.markov(spark).factors[0], Factor)


def test_pomdpx_round_trip(spark):
    text = """<pomdpx version="1.0"><Description>d</Description><Discount>0.95</Discount><Variable><StateVar vnamePrev="a_0" vnameCurr="a_1" fullyObs="true"><NumValues>2</NumValues></StateVar><ActionVar vname="act"><ValueEnum>l r</ValueEnum></ActionVar></Variable>
    <InitialStateBelief><CondProb><Var>a_0</Var><Parent>null</Parent><Parameter type="TBL"><Entry><Instance>-</Instance><ProbTable>0.3 0.7</ProbTable></Entry></Parameter></CondProb></InitialStateBelief>
    <RewardFunction><Func><Var>r</Var><Parent>act a_0</Parent><Parameter type="DD"><DAG><Node var="act"><Edge val="l"><Terminal>1</Terminal></Edge><Edge val="r"><Terminal>-1</Terminal></Edge></Node></DAG></Parameter></Func></RewardFunction></pomdpx>"""
    m = models.read_pomdpx(text)
    assert m["discount"] == 0.95 and m["variables"]["StateVar"][0]["values"] == ["s0", "s1"] and m["functions"]["RewardFunction"][0]["diagram"]["edges"] == {"l": "1", "r": "-1"}
    assert models.read_pomdpx(models.write_pomdpx(m)) == m
    assert models.pomdpx_rows(spark, m).first().value == ["0.3", "0.7"]


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    spark.range(400).selectExpr("id % 3 AS a", "id % 4 AS b", "timestamp_seconds(id * 60) AS ts").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a long, b long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    query = online.streaming_counts(stream, ["a", "b"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, batch.groupBy("a", "b").count().collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    cpd = online.cpd_of_counts(spark.table("counts"), "a", ["b"], {"a": [0, 1, 2], "b": [0, 1, 2, 3]})
    assert cpd.is_valid(1e-9)
    query = online.windowed_counts(stream, ["a"], "ts", "1 hour", "10 hours").writeStream.outputMode("update").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").agg(F.max("n")).first()[0] == 20


def test_beliefs_of_a_table(spark):
    start, move, emit = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.1, 0.9]]
    rows = [("u", t, s) for t, s in enumerate(["x", "y", "?", "y"])] + [("v", 0, "x")]
    got = {r.k: r for r in online.filtered_batch(spark.createDataFrame(rows, "k string, t int, s string"), "k", "t", "s", start, move, emit, ["x", "y"]).collect()}
    belief = None
    for s in ("x", "y", "?", "y"):
        belief = online.step(belief, np.array(start), np.array(move), np.array(emit), {"x": 0, "y": 1}.get(s))
    np.testing.assert_allclose(got["u"].belief, belief)
    assert got["u"].events == 4 and got["v"].belief[0] == pytest.approx(0.42 / 0.46)


def test_densities_and_classes(spark):
    pdf = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    assert density.integrate(pdf) == pytest.approx(1, abs=1e-9) and density.integrate(pdf, hi=1.0) == pytest.approx(normal_cdf(1), abs=1e-9)
    two = density.ContinuousFactor(["x", "y"], lambda x, y: pdf(x) * pdf(y - x))
    assert two.reduce({"y": 0.5}).normalize().assignment(0.25) == pytest.approx(pdf(0) * math.sqrt(2), rel=1e-6)
    assert sum(density.rounding(normal_cdf, -5, 5, 10)) == pytest.approx(1, abs=1e-5)
    assert sum(density.unbiased(pdf, normal_cdf, -5, 5, 11)) == pytest.approx(1, abs=1e-5)
    d = spark.createDataFrame([(float(x),) for x in range(11)] + [(None,)], "x double")
    assert [r[0] for r in d.select(equal_width(d, "x", 2)).collect()] == [0] * 6 + [1] * 5 + [None]
    assert [r[0] for r in d.select(equal_frequency(d, "x", 2)).collect()] == [0] * 6 + [1] * 5 + [None]


def test_example_networks(spark):
    from credalis.sources.examples import NETWORKS, example

    for name in NETWORKS:
        assert example(spark, name).check_model()
    asia = example(spark, "asia")
    np.testing.assert_allclose(asia.query(["either"]).values(), [0.064828, 0.935172], atol=1e-6)
    np.testing.assert_allclose(asia.query(["dysp"]).values()[0], 0.435971, atol=1e-5)


def test_sample_stream(spark):
    from credalis.sources.examples import example
    from credalis.streaming.generator import sample_stream

    query = sample_stream(spark, example(spark, "sprinkler"), rows_per_second=50).writeStream.format("memory").queryName("drawn").start()
    import time

    end = time.time() + 60
    while time.time() < end and spark.table("drawn").count() < 50:
        time.sleep(1)
    query.stop()
    rows = spark.table("drawn")
    assert rows.count() >= 50 and rows.filter("Wet = 'yes' AND Rain = 'no' AND Sprinkler = 'no'").isEmpty()
    assert {r[0] for r in rows.select("Cloudy").distinct().collect()} == {"yes", "no"}
