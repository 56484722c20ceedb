"""The engine's queries over the driver's tables, and the same in SQL.

Most run on a coded view of ``lineitem``: return flag, line status, and discount, tax, quantity and year as classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.functions.discretize import equal_frequency, equal_width
from credalis.operators import causal, citests, mcmc, metrics, scores, structure
from credalis.operators.counts import family_counts, state_counts, state_names
from credalis.operators.factors import VALUE, Factor, FactorDict, FactorSet, JointDistribution, product, q
from credalis.operators.gaussian import Gram, LinearGaussianNetwork, ate_linear, two_stage_least_squares
from credalis.operators.markov import FactorGraph, MarkovNetwork
from credalis.operators.network import BayesianNetwork, expectation_maximization, mle_cpd, naive_bayes, smoothed_cpd
from credalis.plans.graph import DAG
from credalis.sources import models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CODED = """coded AS (SELECT l_returnflag AS rf, l_linestatus AS ls, CAST(l_discount > 0.05 AS BIGINT) AS disc, CAST(l_tax > 0.04 AS BIGINT) AS tax,
    CAST(ceil(l_quantity / 10) AS BIGINT) AS qty, CAST(year(l_shipdate) AS BIGINT) AS yr, l_orderkey AS k FROM lineitem)"""
#: Planted dependence: b follows a, c follows a and b.
PLANTED = """planted AS (SELECT CAST(l_orderkey % 2 AS BIGINT) AS a,
    CAST(CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 1 - l_orderkey % 2 ELSE l_orderkey % 2 END AS BIGINT) AS b,
    CAST(CASE WHEN l_partkey % 7 = 0 THEN l_suppkey % 2 ELSE greatest(l_orderkey % 2, l_linenumber % 2) END AS BIGINT) AS c,
    CAST(l_linenumber % 2 AS BIGINT) AS d FROM lineitem)"""


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return lineitem(spark, sf).select(
        c("l_returnflag").alias("rf"), c("l_linestatus").alias("ls"), (c("l_discount") > 0.05).cast("long").alias("disc"), (c("l_tax") > 0.04).cast("long").alias("tax"),
        F.ceil(c("l_quantity") / 10).cast("long").alias("qty"), F.year("l_shipdate").cast("long").alias("yr"), c("l_orderkey").alias("k"),
    )


def planted(spark: SparkSession, sf: str) -> DataFrame:
    k, line, part, supp = (F.col(f"l_{n}") for n in ("orderkey", "linenumber", "partkey", "suppkey"))
    a, d = k % 2, line % 2
    b = F.when((k + line) % 5 == 0, 1 - a).otherwise(a)
    return lineitem(spark, sf).select(a.cast("long").alias("a"), b.cast("long").alias("b"), F.when(part % 7 == 0, supp % 2).otherwise(F.greatest(a, d)).cast("long").alias("c"), d.cast("long").alias("d"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, column: str = VALUE, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


# --- counts and parameters ----------------------------------------------------------------------------------------


@query(f"WITH {CODED} SELECT ls, rf, count(*) AS n FROM coded GROUP BY ls, rf")
def state_counts_pair(spark, sf):
    return state_counts(coded(spark, sf), "ls", ["rf"])


@query(f"""WITH {CODED}, g AS (SELECT * FROM (SELECT DISTINCT qty FROM coded), (SELECT DISTINCT rf FROM coded), (SELECT DISTINCT yr FROM coded))
SELECT g.qty, g.rf, g.yr, CAST(count(c.k) AS BIGINT) AS n FROM g LEFT JOIN coded c ON g.qty = c.qty AND g.rf = c.rf AND g.yr = c.yr GROUP BY ALL""")
def state_counts_grid(spark, sf):
    data = coded(spark, sf)
    family = ["qty", "rf", "yr"]
    return state_counts(data, "qty", ["rf", "yr"], states=state_names(data, family)).select(*family, F.col("n").cast("long").alias("n"))


@query(f"WITH {CODED} SELECT ls, rf, CAST(sum(qty) AS BIGINT) AS n FROM coded GROUP BY ls, rf")
def state_counts_weighted(spark, sf):
    return state_counts(coded(spark, sf).withColumn("w", F.col("qty")), "ls", ["rf"], weight="w").select("ls", "rf", F.col("n").cast("long").alias("n"))


@query(f"""WITH {CODED} SELECT coalesce(rf, '*') AS rf, coalesce(ls, '*') AS ls, coalesce(CAST(disc AS VARCHAR), '*') AS disc, coalesce(CAST(qty AS VARCHAR), '*') AS qty, count(*) AS n
FROM coded GROUP BY GROUPING SETS ((rf, ls), (rf, disc), (ls, disc), (rf, ls, disc), (qty), (rf, qty))""")
def family_counts_grouping_sets(spark, sf):
    sets = [["rf", "ls"], ["rf", "disc"], ["ls", "disc"], ["rf", "ls", "disc"], ["qty"], ["rf", "qty"]]
    found = family_counts(coded(spark, sf), sets)
    rows = [(dict(zip(sorted(f), k, strict=True)), int(n)) for f, cells in found.items() for k, n in cells.items()]
    return spark.createDataFrame([(*(str(k.get(c, "*")) for c in ("rf", "ls", "disc", "qty")), n) for k, n in rows], "rf string, ls string, disc string, qty string, n long")


@query(f"WITH {CODED} SELECT ls, rf, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rf), 6) AS value FROM coded GROUP BY ls, rf")
def mle_cpd_ls(spark, sf):
    return rounded(mle_cpd(coded(spark, sf), "ls", ["rf"]).df)


def _smoothed(alpha: str) -> str:
    return f"""WITH {CODED}, g AS (SELECT * FROM (SELECT DISTINCT disc FROM coded), (SELECT DISTINCT qty FROM coded), (SELECT DISTINCT rf FROM coded)),
n AS (SELECT g.disc, g.qty, g.rf, count(c.k) + {alpha} AS n FROM g LEFT JOIN coded c ON g.disc = c.disc AND g.qty = c.qty AND g.rf = c.rf GROUP BY ALL)
SELECT disc, qty, rf, round(n / sum(n) OVER (PARTITION BY qty, rf), 6) AS value FROM n"""


@query(_smoothed("CAST(1 AS DOUBLE)"))
def k2_cpd(spark, sf):
    return rounded(smoothed_cpd(coded(spark, sf), "disc", ["qty", "rf"], alpha=1.0).df)


@query(_smoothed("10 / CAST((SELECT count(*) FROM g) AS DOUBLE)"))
def bdeu_cpd(spark, sf):
    net = BayesianNetwork([("qty", "disc"), ("rf", "disc")]).fit(coded(spark, sf).select("disc", "qty", "rf"), prior="BDeu", equivalent_sample_size=10)
    return rounded(net.cpds["disc"].df.select("disc", "qty", "rf", VALUE))


@query(f"""WITH {CODED}, old AS (SELECT ls, rf, CAST(count(*) AS DOUBLE) AS n FROM coded WHERE yr <= 1995 GROUP BY ls, rf),
p AS (SELECT ls, rf, n / sum(n) OVER (PARTITION BY rf) * 1000 / 3 AS alpha FROM old),
new AS (SELECT ls, rf, count(*) AS n FROM coded WHERE yr > 1995 GROUP BY ls, rf),
j AS (SELECT ls, rf, coalesce(n, 0) + alpha AS n FROM p LEFT JOIN new USING (ls, rf))
SELECT ls, rf, round(n / sum(n) OVER (PARTITION BY rf), 6) AS value FROM j""")
def dirichlet_update(spark, sf):
    data = coded(spark, sf)
    net = BayesianNetwork([("rf", "ls")]).fit(data.filter("yr <= 1995").select("rf", "ls"))
    return rounded(net.fit_update(data.filter("yr > 1995").select("rf", "ls"), 1000).cpds["ls"].df)


@query(f"WITH {CODED} SELECT qty, rf, round(CAST(sum(yr) AS DOUBLE) / sum(sum(yr)) OVER (PARTITION BY rf), 6) AS value FROM coded GROUP BY qty, rf")
def mle_cpd_weighted(spark, sf):
    return rounded(mle_cpd(coded(spark, sf), "qty", ["rf"], weight="yr").df)


# --- factor algebra -----------------------------------------------------------------------------------------------

_PAIR = f"""WITH {CODED}, f AS (SELECT rf, ls, CAST(count(*) AS DOUBLE) AS v FROM coded GROUP BY rf, ls),
g AS (SELECT ls, disc, CAST(count(*) AS DOUBLE) AS v FROM coded GROUP BY ls, disc), h AS (SELECT ls, CAST(count(*) AS DOUBLE) AS v FROM coded GROUP BY ls) """


def _pair(spark, sf):
    data = coded(spark, sf)
    return Factor.from_data(data, ["rf", "ls"]), Factor.from_data(data, ["ls", "disc"]), Factor.from_data(data, ["ls"])


@query(_PAIR + "SELECT rf, f.ls, disc, f.v * g.v AS value FROM f JOIN g ON f.ls = g.ls")
def factor_product(spark, sf):
    f, g, _ = _pair(spark, sf)
    return f.product(g).df


@query(_PAIR + "SELECT rf, f.ls, round(f.v / h.v, 6) AS value FROM f JOIN h ON f.ls = h.ls")
def factor_divide(spark, sf):
    f, _, h = _pair(spark, sf)
    return rounded(f.divide(h).df)


@query(_PAIR + "SELECT rf, f.ls, disc, f.v + g.v AS value FROM f JOIN g ON f.ls = g.ls")
def factor_sum(spark, sf):
    f, g, _ = _pair(spark, sf)
    return f.plus(g).df


@query(_PAIR + "SELECT rf, sum(v) AS value FROM f GROUP BY rf")
def factor_marginalize(spark, sf):
    return _pair(spark, sf)[0].marginalize(["ls"]).df


@query(_PAIR + "SELECT rf, max(v) AS value FROM f GROUP BY rf")
def factor_maximize(spark, sf):
    return _pair(spark, sf)[0].maximize(["ls"]).df


@query(_PAIR + "SELECT rf, v AS value FROM f WHERE ls = 'O'")
def factor_reduce(spark, sf):
    return _pair(spark, sf)[0].reduce({"ls": "O"}).df


@query(_PAIR + "SELECT rf, ls, round(v / sum(v) OVER (), 6) AS value FROM f")
def factor_normalize(spark, sf):
    return rounded(_pair(spark, sf)[0].normalize().df)


@query(_PAIR + "SELECT rf, ls FROM f ORDER BY v DESC, rf, ls LIMIT 1")
def factor_argmax(spark, sf):
    best = _pair(spark, sf)[0].argmax()
    return spark.createDataFrame([(best["rf"], best["ls"])], "rf string, ls string")


@query(_PAIR + "SELECT rf, ls, CAST(1 AS DOUBLE) AS value FROM f")
def factor_identity(spark, sf):
    return _pair(spark, sf)[0].identity().df


@query(_PAIR + "SELECT disc, sum(f.v * g.v) AS value FROM f JOIN g ON f.ls = g.ls WHERE rf = 'A' GROUP BY disc")
def sum_product_contraction(spark, sf):
    f, g, _ = _pair(spark, sf)
    return f.reduce({"rf": "A"}).product(g).marginalize(["ls"]).df


@query(_PAIR + "SELECT sum(f.v * g.v) AS z FROM f JOIN g ON f.ls = g.ls")
def partition_function(spark, sf):
    f, g, _ = _pair(spark, sf)
    return f.product(g).df.agg(F.sum(VALUE).alias("z"))


@query(_PAIR + "SELECT rf, round(v / sum(v) OVER (), 6) AS value FROM f WHERE ls = 'F'")
def conditional_distribution(spark, sf):
    joint = _pair(spark, sf)[0].normalize()
    return rounded(JointDistribution(joint.df, joint.variables, joint.states).conditional_distribution({"ls": "F"}).df)


@query(f"""WITH {CODED}, p AS (SELECT ls, rf, disc, CAST(count(*) AS DOUBLE) AS n FROM coded GROUP BY ALL), c AS (SELECT ls, rf, disc, n / sum(n) OVER (PARTITION BY rf, disc) AS v FROM p),
s AS (SELECT ls, rf, sum(v) AS v FROM c GROUP BY ls, rf) SELECT ls, rf, round(v / sum(v) OVER (PARTITION BY rf), 6) AS value FROM s""")
def cpd_marginalize(spark, sf):
    return rounded(mle_cpd(coded(spark, sf), "ls", ["rf", "disc"]).marginalize(["disc"]).df)


# --- exact inference ----------------------------------------------------------------------------------------------

_NET = f"""WITH {CODED}, a AS (SELECT rf, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p FROM coded GROUP BY rf),
b AS (SELECT ls, rf, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rf) AS p FROM coded GROUP BY ls, rf),
c AS (SELECT disc, rf, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rf) AS p FROM coded GROUP BY disc, rf),
d AS (SELECT tax, ls, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY ls) AS p FROM coded GROUP BY tax, ls),
j AS (SELECT a.rf, b.ls, c.disc, d.tax, a.p * b.p * c.p * d.p AS p FROM a JOIN b ON a.rf = b.rf JOIN c ON a.rf = c.rf JOIN d ON b.ls = d.ls) """


def fitted(spark: SparkSession, sf: str) -> BayesianNetwork:
    return BayesianNetwork([("rf", "ls"), ("rf", "disc"), ("ls", "tax")]).fit(coded(spark, sf).select("rf", "ls", "disc", "tax"))


@query(_NET + "SELECT ls, round(sum(p) / (SELECT sum(p) FROM j WHERE disc = 1), 6) AS value FROM j WHERE disc = 1 GROUP BY ls")
def ve_query(spark, sf):
    return rounded(fitted(spark, sf).query(["ls"], {"disc": 1}).df)


@query(_NET + "SELECT rf, disc, round(sum(p) / (SELECT sum(p) FROM j WHERE tax = 0), 6) AS value FROM j WHERE tax = 0 GROUP BY rf, disc")
def ve_query_joint(spark, sf):
    return rounded(fitted(spark, sf).query(["rf", "disc"], {"tax": 0}).df)


@query(_NET + "SELECT rf, ls FROM (SELECT rf, ls, sum(p) AS p FROM j WHERE tax = 1 GROUP BY rf, ls) ORDER BY p DESC, rf, ls LIMIT 1")
def ve_map(spark, sf):
    best = fitted(spark, sf).map_query(["rf", "ls"], {"tax": 1})
    return spark.createDataFrame([(best["rf"], best["ls"])], "rf string, ls string")


@query(_NET + "SELECT ls, round(max(p), 8) AS value FROM j WHERE disc = 1 GROUP BY ls")
def max_marginal(spark, sf):
    return rounded(fitted(spark, sf).max_marginal(["ls"], {"disc": 1}).df, digits=8)


@query(_NET + """, w AS (SELECT rf, p * CASE ls WHEN 'F' THEN 0.3 ELSE 0.9 END AS p FROM j WHERE disc = 0) SELECT rf, round(sum(p) / (SELECT sum(p) FROM w), 6) AS value FROM w GROUP BY rf""")
def virtual_evidence_query(spark, sf):
    net = fitted(spark, sf)
    like = Factor.of(spark, ["ls"], [0.3, 0.9], states={"ls": net.states["ls"]})
    return rounded(net.query(["rf"], {"disc": 0}, [like]).df)


@query(_NET + "SELECT rf, ls, disc, tax, round(p, 8) AS value FROM j")
def joint_distribution(spark, sf):
    return rounded(fitted(spark, sf).joint().df, digits=8)


@query(_NET + "SELECT round(sum(p), 8) AS p FROM j WHERE rf = 'R' AND tax = 1")
def state_probability(spark, sf):
    return spark.createDataFrame([(round(fitted(spark, sf).get_state_probability({"rf": "R", "tax": 1}), 8),)], "p double")


@query(_NET + """, m AS (SELECT disc, tax, rf, ls, p, row_number() OVER (PARTITION BY disc, tax ORDER BY p DESC, rf, ls) AS r FROM j)
SELECT c.disc, c.tax, m.rf, m.ls, count(*) AS n FROM coded c JOIN m ON c.disc = m.disc AND c.tax = m.tax AND r = 1 GROUP BY ALL""")
def predict_map(spark, sf):
    return fitted(spark, sf).predict(coded(spark, sf).select("disc", "tax")).select("disc", "tax", "rf", "ls").groupBy("disc", "tax", "rf", "ls").agg(F.count(F.lit(1)).alias("n"))


@query(_NET + """, m AS (SELECT disc, tax, sum(CASE WHEN ls = 'F' THEN p ELSE 0 END) / sum(p) AS f, sum(CASE WHEN ls = 'O' THEN p ELSE 0 END) / sum(p) AS o FROM j GROUP BY disc, tax)
SELECT c.disc, c.tax, round(f, 6) AS "ls_F", round(o, 6) AS "ls_O", count(*) AS n FROM coded c JOIN m ON c.disc = m.disc AND c.tax = m.tax GROUP BY ALL""")
def predict_proba(spark, sf):
    out = fitted(spark, sf).predict_probability(coded(spark, sf).select("disc", "tax"))
    return out.groupBy("disc", "tax", F.round("ls_F", 6).alias("ls_F"), F.round("ls_O", 6).alias("ls_O")).agg(F.count(F.lit(1)).alias("n"))


@query(_NET + """SELECT round(sum(ln(a.p) + ln(b.p) + ln(c.p) + ln(d.p)), 3) AS log_likelihood FROM coded x JOIN a ON x.rf = a.rf JOIN b ON x.rf = b.rf AND x.ls = b.ls JOIN c ON x.rf = c.rf AND x.disc = c.disc JOIN d ON x.ls = d.ls AND x.tax = d.tax""")
def log_likelihood(spark, sf):
    data = coded(spark, sf).select("rf", "ls", "disc", "tax")
    return fitted(spark, sf).log_probability(data).agg(F.round(F.sum("log_p"), 3).alias("log_likelihood"))


@query(f"""WITH {CODED}, c AS (SELECT rf, count(*) AS n FROM coded GROUP BY rf), t AS (SELECT count(*) AS t FROM coded),
d AS (SELECT rf, disc, count(*) AS n FROM coded GROUP BY ALL), x AS (SELECT rf, qty, count(*) AS n FROM coded GROUP BY ALL),
s AS (SELECT disc, qty, c.rf, CAST(c.n AS DOUBLE) / t * d.n / c.n * x.n / c.n AS p FROM c, t, d, x WHERE d.rf = c.rf AND x.rf = c.rf),
b AS (SELECT disc, qty, arg_max(rf, p) AS rf FROM s GROUP BY disc, qty) SELECT b.rf, count(*) AS n FROM coded JOIN b USING (disc, qty) GROUP BY b.rf""")
def naive_bayes_classify(spark, sf):
    data = coded(spark, sf).select("rf", "disc", "qty")
    return naive_bayes(data, "rf").predict(data.select("disc", "qty")).groupBy("rf").agg(F.count(F.lit(1)).alias("n"))


# --- scores -------------------------------------------------------------------------------------------------------

_CELLS = f"""WITH {PLANTED}, n AS (SELECT a, d, c, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY a, d, c), t AS (SELECT a, d, sum(n) AS t, count(*) AS k FROM n GROUP BY a, d) """


def _score(name: str, sql: str) -> None:
    def run(spark, sf):
        return scores.local_score(planted(spark, sf), "c", ["a", "d"], name).select(F.round("score", 3).alias("score"))

    run.__name__ = f"{name}_score"
    query(_CELLS + sql)(run)


_score("k2", "SELECT round((SELECT sum(lgamma(n + 1)) FROM n) - (SELECT sum(lgamma(t + 2)) FROM t) + 4 * lgamma(2), 3) AS score")
_score("bdeu", "SELECT round((SELECT sum(lgamma(n + 1.25)) FROM n) + (SELECT sum((2 - k) * lgamma(1.25) - lgamma(t + 2.5) + lgamma(2.5) - 2 * lgamma(1.25)) FROM t), 3) AS score")
_score("bds", "SELECT round((SELECT sum(lgamma(n + 1.25)) FROM n) + (SELECT sum((2 - k) * lgamma(1.25) - lgamma(t + 10.0 / (SELECT count(*) FROM t))) + count(*) * lgamma(10.0 / count(*)) + (4 - count(*)) * 2 * lgamma(1.25) - 8 * lgamma(1.25) FROM t), 3) AS score")
_score("bic", "SELECT round((SELECT sum(n * ln(n / t)) FROM n JOIN t USING (a, d)) - 0.5 * ln((SELECT sum(n) FROM n)) * 4, 3) AS score")
_score("aic", "SELECT round((SELECT sum(n * ln(n / t)) FROM n JOIN t USING (a, d)) - 4, 3) AS score")


# --- independence tests -------------------------------------------------------------------------------------------

_TABLE = f"""WITH {CODED}, n AS (SELECT rf, qty, disc, CAST(count(*) AS DOUBLE) AS o FROM coded GROUP BY ALL),
g AS (SELECT x.disc, x.rf, y.qty FROM (SELECT DISTINCT disc, rf FROM n) x JOIN (SELECT DISTINCT disc, qty FROM n) y USING (disc)),
f AS (SELECT g.disc, g.rf, g.qty, coalesce(o, 0) AS o FROM g LEFT JOIN n ON g.disc = n.disc AND g.rf = n.rf AND g.qty = n.qty),
e AS (SELECT *, sum(o) OVER (PARTITION BY disc, rf) * sum(o) OVER (PARTITION BY disc, qty) / sum(o) OVER (PARTITION BY disc) AS e FROM f)
SELECT round(sum({{}}), 4) AS statistic, (SELECT sum(d) FROM (SELECT (count(DISTINCT rf) - 1) * (count(DISTINCT qty) - 1) AS d FROM f GROUP BY disc))::BIGINT AS dof FROM e"""


def _divergence(name: str, lam: float | str, term: str) -> None:
    def run(spark, sf):
        out = citests.power_divergence(coded(spark, sf), "rf", "qty", ["disc"], lam)
        return out.select(F.round("statistic", 4).alias("statistic"), "dof")

    run.__name__ = name
    query(_TABLE.format(term))(run)


_divergence("chi_square_conditional", 1.0, "(o - e) * (o - e) / e")
_divergence("g_square", 0.0, "CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END")
_divergence("cressie_read", 2 / 3, "2 / (2.0::DOUBLE / 3 * (2.0::DOUBLE / 3 + 1)) * o * (pow(o / e, 2.0::DOUBLE / 3) - 1)")
_divergence("freeman_tukey", -0.5, "-8 * o * (pow(o / e, -0.5) - 1)")
_divergence("modified_log_likelihood", -1.0, "2 * e * ln(e / o)")


@query(f"WITH {CODED}, n AS (SELECT rf, ls, CAST(count(*) AS DOUBLE) AS o FROM coded GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY rf) * sum(o) OVER (PARTITION BY ls) / sum(o) OVER () AS e FROM n) SELECT round(sum((o - e) * (o - e) / e), 4) AS statistic, CAST(2 AS BIGINT) AS dof FROM e")
def chi_square_marginal(spark, sf):
    return citests.power_divergence(coded(spark, sf), "rf", "ls").select(F.round("statistic", 4).alias("statistic"), "dof")


@query(f"WITH {PLANTED}, n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL) SELECT round(sum(n / t * ln(n * t / (x * y))), 6) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS x, sum(n) OVER (PARTITION BY b) AS y FROM n)")
def mutual_information(spark, sf):
    return citests.mutual_information(planted(spark, sf), "a", "b").select(F.round("mi", 6).alias("mi"))


@query(f"WITH {PLANTED}, n AS (SELECT a, c, d, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL) SELECT round(sum(n / t * ln(n * z / (x * y))), 6) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY d) AS z, sum(n) OVER (PARTITION BY a, d) AS x, sum(n) OVER (PARTITION BY c, d) AS y FROM n)")
def conditional_mi(spark, sf):
    return citests.mutual_information(planted(spark, sf), "a", "c", ["d"]).select(F.round("mi", 6).alias("mi"))


_MI = " UNION ALL ".join(f"SELECT '{x}' AS u, '{y}' AS v, round(sum(n / t * ln(n * t / (x * y))), 6) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY {x}) AS x, sum(n) OVER (PARTITION BY {y}) AS y FROM (SELECT {x}, {y}, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL))" for x, y in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")))


@query(f"WITH {PLANTED} {_MI}")
def chow_liu_weights(spark, sf):
    w = structure.weights(planted(spark, sf), ["a", "b", "c", "d"])
    return spark.createDataFrame([(u, v, round(x, 6)) for (u, v), x in w.items()], "u string, v string, mi double")


# --- structure and causal -----------------------------------------------------------------------------------------


#: b follows a, c follows a and d: the edges that are planted, without direction where data can't tell it.
_SKELETON = "SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('c', 'd')) t(src, dst)"


def _skeleton(spark, edges) -> DataFrame:
    return spark.createDataFrame(sorted(tuple(sorted(e)) for e in edges), "src string, dst string")


@query(_SKELETON)
def hill_climb_planted(spark, sf):
    data = planted(spark, sf)
    return _skeleton(spark, structure.hill_climb(structure.Score(data, "bic"), data.columns).edges)


@query(_SKELETON)
def pc_planted(spark, sf):
    data = planted(spark, sf)
    return _skeleton(spark, structure.pc(citests.CITests(data), data.columns, return_type="skeleton")[0].edges)


@query(_SKELETON)
def greedy_search_planted(spark, sf):
    data = planted(spark, sf)
    return _skeleton(spark, structure.greedy_equivalence(structure.Score(data, "bic"), data.columns).edges)


@query(f"""WITH {PLANTED}, s AS (SELECT a, c, d, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL), x AS (SELECT a, d, sum(n) AS n FROM s GROUP BY a, d), z AS (SELECT d, sum(n) AS n FROM s GROUP BY d)
SELECT s.a, s.c, round(sum(s.n / x.n * z.n / (SELECT sum(n) FROM s)), 6) AS p FROM s JOIN x ON s.a = x.a AND s.d = x.d JOIN z ON s.d = z.d GROUP BY s.a, s.c""")
def do_query_backdoor(spark, sf):
    return rounded(causal.adjusted(planted(spark, sf), "a", "c", ["d"]), "p")


@query(f"""WITH {PLANTED}, t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM planted), x AS (SELECT a, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY a), xm AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY a, b),
xmy AS (SELECT a, b, c, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL), i AS (SELECT xmy.b, xmy.c, sum(xmy.n / xm.n * x.n / t) AS p FROM xmy JOIN xm ON xmy.a = xm.a AND xmy.b = xm.b JOIN x ON xmy.a = x.a, t GROUP BY xmy.b, xmy.c)
SELECT xm.a, i.c, round(sum(xm.n / x.n * i.p), 6) AS p FROM xm JOIN x ON xm.a = x.a JOIN i ON xm.b = i.b GROUP BY xm.a, i.c""")
def frontdoor_query(spark, sf):
    return rounded(causal.frontdoor_adjusted(planted(spark, sf), "a", "b", "c"), "p")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS ate FROM lineitem")
def ate_linear_quantity(spark, sf):
    return spark.createDataFrame([(round(ate_linear(lineitem(spark, sf), "l_quantity", "l_extendedprice"), 4),)], "ate double")


def nations(spark: SparkSession, sf: str) -> DAG:
    """Each nation points to its region, and each region to the world."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    return DAG(sorted({(f"n{r[0]:02}", f"r{r[1]}") for r in rows} | {(f"r{r[1]}", "world") for r in rows}))


_NATIONS = """WITH e AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS u, 'r' || CAST(n_regionkey AS VARCHAR) AS v FROM nation UNION SELECT 'r' || CAST(n_regionkey AS VARCHAR), 'world' FROM nation),
married AS (SELECT DISTINCT x.u AS u, y.u AS v, x.v AS child FROM e x JOIN e y ON x.v = y.v AND x.u < y.u) """


@query("""WITH a AS (SELECT n_nationkey AS u, 100 + n_regionkey AS v FROM nation), b AS (SELECT CASE WHEN u % 2 = 0 THEN v ELSE u END AS u, CASE WHEN u % 2 = 0 THEN u ELSE v END AS v FROM a WHERE u % 3 <> 0),
d AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT count(*) AS shd FROM (SELECT DISTINCT least(u, v), greatest(u, v) FROM d)""")
def structural_hamming_distance(spark, sf):
    a = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    odd = F.col("src") % 2 == 0
    b = a.filter("src % 3 <> 0").select(F.when(odd, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return metrics.shd_frames(a, b)


@query(_NATIONS + "SELECT least(u, v) AS u, greatest(u, v) AS v FROM e UNION SELECT u, v FROM married")
def moral_edges(spark, sf):
    return spark.createDataFrame(sorted(tuple(sorted(e)) for e in nations(spark, sf).moralize().edges), "u string, v string")


@query(_NATIONS + "SELECT v AS node FROM e WHERE u = 'n03' UNION SELECT u FROM e WHERE v = 'n03' UNION SELECT CASE WHEN u = 'n03' THEN v ELSE u END FROM married WHERE 'n03' IN (u, v)")
def markov_blanket(spark, sf):
    return spark.createDataFrame([(n,) for n in sorted(nations(spark, sf).markov_blanket("n03"))], "node string")


@query(_NATIONS + "SELECT u, v, child FROM married")
def immoralities(spark, sf):
    return spark.createDataFrame(sorted((*sorted(p), n) for p, n in nations(spark, sf).immoralities()), "u string, v string, child string")


@query(_NATIONS + ", p AS (SELECT u AS a FROM e WHERE u LIKE 'n%') SELECT x.a AS u, y.a AS v, EXISTS (SELECT 1 FROM e f JOIN e g ON f.v = g.v WHERE f.u = x.a AND g.u = y.a) AS connected FROM p x JOIN p y ON x.a < y.a")
def dconnection_given_collider(spark, sf):
    """Nations are connected given the regions exactly if they share one."""
    dag = nations(spark, sf)
    given = [n for n in dag.nodes if n.startswith("r")]
    some = sorted(n for n in dag.nodes if n.startswith("n"))
    return spark.createDataFrame([(u, v, bool(dag.is_dconnected(u, v, given))) for i, u in enumerate(some) for v in some[i + 1 :]], "u string, v string, connected boolean")


# --- continuous, discretised, sequences ---------------------------------------------------------------------------


@query("SELECT round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 4) AS variance FROM lineitem")
def linear_gaussian_root(spark, sf):
    c = LinearGaussianNetwork(nodes=["l_quantity"]).fit(lineitem(spark, sf)).cpds["l_quantity"]
    return spark.createDataFrame([(round(c.intercept, 6), round(c.variance, 4))], "mean double, variance double")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def linear_gaussian_child(spark, sf):
    c = LinearGaussianNetwork([("l_quantity", "l_extendedprice")]).fit(lineitem(spark, sf)).cpds["l_extendedprice"]
    return spark.createDataFrame([(round(c.intercept, 3), round(c.slopes[0], 4))], "intercept double, slope double")


_NUMBERS = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS u, '{b}' AS v, round(covar_samp({a}, {b}), 6) AS cov FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def covariance_matrix(spark, sf):
    g = Gram.of(lineitem(spark, sf), _NUMBERS).cov()
    return spark.createDataFrame([(a, b, round(float(g[i, j]), 6)) for i, a in enumerate(_NUMBERS) for j, b in enumerate(_NUMBERS) if j >= i], "u string, v string, cov double")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson_marginal(spark, sf):
    return spark.createDataFrame([(round(citests.GaussianTests(lineitem(spark, sf).select("l_quantity", "l_extendedprice")).test("l_quantity", "l_extendedprice")[0], 6),)], "r double")


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 5)), 1) - 1 AS INTEGER) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1")
def discretize_equal_width(spark, sf):
    return lineitem(spark, sf).select(equal_width(lineitem(spark, sf), "l_extendedprice", 5).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS c FROM lineitem)
SELECT CAST(CASE WHEN l_extendedprice <= c[1] THEN 0 WHEN l_extendedprice <= c[2] THEN 1 WHEN l_extendedprice <= c[3] THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1""")
def discretize_quantile(spark, sf):
    return lineitem(spark, sf).select(equal_frequency(lineitem(spark, sf), "l_extendedprice", 4).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = "p AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)"


@query(f"WITH {_PAIRS} SELECT state, next, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY state), 6) AS p FROM p WHERE next IS NOT NULL GROUP BY state, next")
def markov_transition_matrix(spark, sf):
    from credalis.operators.sequences import transition_matrix

    return rounded(transition_matrix(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "event_type"), "p")


@query(f"WITH {_PAIRS} SELECT state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY state, next")
def dbn_pair_counts(spark, sf):
    from credalis.operators.sequences import slice_pairs

    return slice_pairs(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], ["event_type"]).select(q("event_type_0").alias("state"), q("event_type_1").alias("next")).groupBy("state", "next").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor((r - 1) / 100) AS BIGINT) AS block, event_type AS state, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL")
def windowed_state_frequency(spark, sf):
    from credalis.operators.sequences import block_counts

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("g", F.col("user_id") % 10)
    return block_counts(events, "g", ["ts", "event_id"], "event_type", 100).groupBy("block", "state").agg(F.sum("n").alias("n"))


# --- messages, potentials, files ----------------------------------------------------------------------------------

_LS = "SELECT ls, round(sum(p) / (SELECT sum(p) FROM j WHERE disc = 1 AND tax = 0), 6) AS value FROM j WHERE disc = 1 AND tax = 0 GROUP BY ls"


@query(_NET + _LS)
def junction_tree_query(spark, sf):
    return rounded(MarkovNetwork.of(fitted(spark, sf)).junction_tree().query(["ls"], {"disc": 1, "tax": 0}).df)


@query(_NET + _LS)
def factor_graph_messages(spark, sf):
    graph = FactorGraph([c.to_factor() for c in fitted(spark, sf).cpds.values()])
    return rounded(graph.propagate(["ls"], {"disc": 1, "tax": 0})["ls"].df)


@query(_NET + "SELECT round(sum(p), 6) AS z FROM j")
def markov_partition_function(spark, sf):
    return spark.createDataFrame([(round(MarkovNetwork.of(fitted(spark, sf)).partition_function(), 6),)], "z double")


@query(_PAIR + "SELECT rf, f.ls, disc, round(f.v * g.v / h.v / (SELECT sum(v) FROM f), 6) AS value FROM f JOIN g ON f.ls = g.ls JOIN h ON f.ls = h.ls")
def junction_tree_potentials(spark, sf):
    data = coded(spark, sf).select("rf", "ls", "disc")
    shape = MarkovNetwork([Factor.from_data(data, ["rf", "ls"]), Factor.from_data(data, ["ls", "disc"])])
    out = product(*shape.junction_tree().fit_potentials(data).factors)
    return rounded(Factor(out.df, ["rf", "ls", "disc"], out.states).df)


@query(_PAIR + "SELECT sum(v * v) AS dot FROM f")
def factor_dict_dot(spark, sf):
    d = FactorDict.from_data(coded(spark, sf), [("rf", "ls")])
    return spark.createDataFrame([(d.dot(d),)], "dot double")


@query(_PAIR + "SELECT disc, sum(f.v * g.v) AS value FROM f JOIN g ON f.ls = g.ls GROUP BY disc")
def factor_set_marginalize(spark, sf):
    f, g, _ = _pair(spark, sf)
    out = product(*FactorSet(f, g).marginalize(["rf", "ls"]).factors)
    return out.df


@query(f"WITH {CODED} SELECT ls, rf, disc, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rf, disc), 6) AS value FROM coded GROUP BY ls, rf, disc")
def model_file_round_trip(spark, sf):
    data = coded(spark, sf).select("rf", "ls", "disc")
    net = BayesianNetwork([("rf", "ls"), ("disc", "ls")]).fit(data)
    back = models.read_bif(models.write_bif(models.Spec.of(net))).network(spark)
    return rounded(back.cpds["ls"].df.select("ls", "rf", F.col("disc").cast("long").alias("disc"), VALUE))


@query("SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS r FROM (SELECT corr(l_extendedprice, l_quantity) AS xy, corr(l_extendedprice, l_partkey) AS xz, corr(l_quantity, l_partkey) AS yz FROM lineitem)")
def partial_correlation(spark, sf):
    g = Gram.of(lineitem(spark, sf), ["l_extendedprice", "l_quantity", "l_partkey"])
    return spark.createDataFrame([(round(g.partial_correlation("l_extendedprice", "l_quantity", ["l_partkey"], center=True), 5),)], "r double")


@query("SELECT round(covar_samp(l_extendedprice, l_partkey % 7 + l_quantity) / covar_samp(l_quantity, l_partkey % 7 + l_quantity), 3) AS effect FROM lineitem")
def instrumental_effect(spark, sf):
    data = lineitem(spark, sf).select("l_extendedprice", "l_quantity", (F.col("l_partkey") % 7 + F.col("l_quantity")).alias("z"))
    return spark.createDataFrame([(round(two_stage_least_squares(data, "l_quantity", "l_extendedprice", ["z"]), 3),)], "effect double")


@query("WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_quantity, round(a + b * l_quantity, 2) AS predicted, count(*) AS n FROM lineitem, r GROUP BY ALL")
def linear_gaussian_predict(spark, sf):
    data = lineitem(spark, sf)
    net = LinearGaussianNetwork([("l_quantity", "l_extendedprice")]).fit(data)
    out = net.predict(data.select("l_quantity"))
    return out.groupBy("l_quantity", F.round("l_extendedprice", 2).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def online_counts(spark, sf):
    from credalis.streaming.online import streaming_counts

    return streaming_counts(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"])


_STEP = "{p} * CASE WHEN big = 0 THEN 0.8 ELSE 0.2 END / ({p} * CASE WHEN big = 0 THEN 0.8 ELSE 0.2 END + (1 - {p}) * CASE WHEN big = 0 THEN 0.3 ELSE 0.7 END)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, CAST(value > 50 AS INTEGER) AS big, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(value > 50 AS INTEGER)) AS r FROM events),
f AS (SELECT user_id, r, {_STEP.format(p="CAST(0.5 AS DOUBLE)")} AS p FROM e WHERE r = 1
    UNION ALL SELECT user_id, r, {_STEP.format(p="q")} FROM (SELECT e.user_id, e.r, e.big, f.p * 0.9 + (1 - f.p) * 0.1 AS q FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
SELECT user_id, round(arg_max(p, r), 6) AS p0, max(r) AS events FROM f GROUP BY user_id""")
def belief_filter(spark, sf):
    from credalis.streaming.online import filtered_batch

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("big", (F.col("value") > 50).cast("int"))
    out = filtered_batch(events, "user_id", "ts", "big", [0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [[0.8, 0.2], [0.3, 0.7]], [0, 1])
    return out.select("user_id", F.round(F.col("belief")[0], 6).alias("p0"), "events")


@query(_SKELETON)
def chow_liu_planted(spark, sf):
    return _skeleton(spark, structure.chow_liu(planted(spark, sf), root="a").edges)


@query("SELECT count(*) > 0 AS best_has_planted_edges FROM lineitem")
def exhaustive_planted(spark, sf):
    """The best of all graphs over four variables has the planted edges."""
    best = structure.exhaustive(structure.Score(planted(spark, sf), "bic"), ["a", "b", "c", "d"])[-1][1]
    return spark.createDataFrame([({("a", "b"), ("a", "c"), ("c", "d")} <= {tuple(sorted(e)) for e in best.edges},)], "best_has_planted_edges boolean")


@query(_SKELETON)
def mmhc_planted(spark, sf):
    data = planted(spark, sf)
    return _skeleton(spark, structure.mmhc(data, structure.Score(data, "bic")).edges)


@query()
def em_latent_class(spark, sf):
    net = BayesianNetwork([("z", "a"), ("z", "b"), ("z", "c")], latents=["z"])
    return expectation_maximization(net, planted(spark, sf).select("a", "b", "c"), {"z": [0, 1]}, rounds=5).cpds["a"].df


@query()
def gibbs_chains(spark, sf):
    return mcmc.gibbs(spark, [c.to_factor() for c in fitted(spark, sf).cpds.values()], 500, chains=8, seed=1).groupBy("rf").agg(F.count(F.lit(1)).alias("n"))


# --- sampling (random, so without SQL) ----------------------------------------------------------------------------


@query()
def forward_sample(spark, sf):
    return fitted(spark, sf).sample(10_000, seed=1).groupBy("rf", "ls").agg(F.count(F.lit(1)).alias("n"))


@query()
def likelihood_weighted_sample(spark, sf):
    return fitted(spark, sf).likelihood_weighted_sample(5000, {"tax": 1}, seed=2).groupBy("rf").agg(F.sum("_weight").alias("w"))


@query()
def approximate_query(spark, sf):
    return fitted(spark, sf).approximate(["ls"], 5000, {"disc": 1}, seed=3).df


# --- wide evidence, missing values, far columns -------------------------------------------------------------------

_WIDE = 30


@query(f"""WITH x AS (SELECT l_returnflag AS rf, k, i, CAST((l_partkey * (2 * i + 1) + l_suppkey * i + CASE l_returnflag WHEN 'A' THEN i WHEN 'N' THEN 1 ELSE 2 END) % (3 + i % 4) = 0 AS BIGINT) AS e FROM (SELECT *, row_number() OVER () AS k FROM lineitem), range({_WIDE}) t(i)),
c AS (SELECT rf, CAST(count(*) AS DOUBLE) AS n FROM x WHERE i = 0 GROUP BY rf), n AS (SELECT rf, i, e, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL),
s AS (SELECT x.k, c.rf, ln(c.n) + sum(ln(n.n / c.n)) AS p FROM x JOIN n ON n.i = x.i AND n.e = x.e JOIN c ON c.rf = n.rf GROUP BY x.k, c.rf, c.n)
SELECT rf, count(*) AS n FROM (SELECT k, arg_max(rf, p) AS rf FROM s GROUP BY k) GROUP BY rf""")
def predict_wide_evidence(spark, sf):
    """Thirty evidence columns: far more combinations than rows."""
    c = F.col
    own = F.when(c("l_returnflag") == "N", 1).otherwise(2)
    data = lineitem(spark, sf).select(c("l_returnflag").alias("rf"), *[((c("l_partkey") * (2 * i + 1) + c("l_suppkey") * i + F.when(c("l_returnflag") == "A", i).otherwise(own)) % (3 + i % 4) == 0).cast("long").alias(f"e{i}") for i in range(_WIDE)])
    return naive_bayes(data, "rf").predict(data.drop("rf")).groupBy("rf").agg(F.count(F.lit(1)).alias("n"))


@query(_NET + """, x AS (SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE disc END AS disc, CASE WHEN k % 7 = 0 THEN NULL ELSE tax END AS tax FROM coded), g AS (SELECT DISTINCT disc, tax FROM x),
s AS (SELECT g.disc, g.tax, j.rf, j.ls, sum(p) AS p FROM g JOIN j ON (g.disc IS NULL OR g.disc = j.disc) AND (g.tax IS NULL OR g.tax = j.tax) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY disc, tax ORDER BY p DESC, rf, ls) AS r FROM s)
SELECT x.disc, x.tax, m.rf, m.ls, count(*) AS n FROM x JOIN m ON x.disc IS NOT DISTINCT FROM m.disc AND x.tax IS NOT DISTINCT FROM m.tax AND r = 1 GROUP BY ALL""")
def predict_missing_evidence(spark, sf):
    """A null in an evidence column is summed out."""
    k = F.col("k")
    data = coded(spark, sf).select(F.when(k % 5 != 0, F.col("disc")).alias("disc"), F.when(k % 7 != 0, F.col("tax")).alias("tax"))
    return fitted(spark, sf).predict(data).groupBy("disc", "tax", "rf", "ls").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(covar_samp(l_quantity, l_discount), 6) AS c, round(var_samp(l_quantity), 4) AS v FROM lineitem")
def covariance_far_from_zero(spark, sf):
    """Columns moved by a hundred million have the same covariance."""
    g = Gram.of(lineitem(spark, sf).select((F.col("l_quantity") + 1e8).alias("q"), (F.col("l_discount") - 1e6).alias("d"))).cov(["q", "d"])
    return spark.createDataFrame([(round(float(g[0, 1]), 6), round(float(g[0, 0]), 4))], "c double, v double")


@query(f"""WITH {PLANTED}, holes AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_orderkey % 2 END AS a, greatest(l_orderkey % 2, l_linenumber % 2) AS c, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_linenumber % 2 END AS d FROM lineitem),
f AS (SELECT * FROM holes WHERE a IS NOT NULL AND d IS NOT NULL), s AS (SELECT a, c, d, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY ALL), x AS (SELECT a, d, sum(n) AS n FROM s GROUP BY a, d), z AS (SELECT d, sum(n) AS n FROM s GROUP BY d)
SELECT CAST(s.a AS BIGINT) AS a, CAST(s.c AS BIGINT) AS c, round(sum(s.n / x.n * z.n / (SELECT sum(n) FROM s)), 6) AS p FROM s JOIN x ON s.a = x.a AND s.d = x.d JOIN z ON s.d = z.d GROUP BY s.a, s.c""")
def backdoor_with_missing_values(spark, sf):
    k, line, part = (F.col(f"l_{n}") for n in ("orderkey", "linenumber", "partkey"))
    data = lineitem(spark, sf).select(F.when(k % 11 != 0, k % 2).cast("long").alias("a"), F.greatest(k % 2, line % 2).cast("long").alias("c"), F.when(part % 13 != 0, line % 2).cast("long").alias("d"))
    return rounded(causal.adjusted(data, "a", "c", ["d"]), "p")


@query(f"""WITH {CODED}, s AS (SELECT ls, disc, rf, CAST(count(*) AS DOUBLE) AS n FROM coded GROUP BY ALL), x AS (SELECT ls, rf, sum(n) AS n FROM s GROUP BY ls, rf), z AS (SELECT rf, sum(n) / sum(sum(n)) OVER () AS p FROM s GROUP BY rf),
w AS (SELECT z.rf, z.p FROM z), g AS (SELECT DISTINCT disc FROM s)
SELECT disc, round(sum(c), 6) AS value FROM (SELECT g.disc, w.p * coalesce(s.n / x.n, CASE WHEN x.n IS NULL THEN 1.0 / (SELECT count(*) FROM g) ELSE 0 END) AS c FROM w CROSS JOIN g LEFT JOIN x ON x.rf = w.rf AND x.ls = 'F' LEFT JOIN s ON s.rf = w.rf AND s.ls = 'F' AND s.disc = g.disc) GROUP BY disc""")
def do_query_network(spark, sf):
    """P(disc | do(ls = F)) in a network where rf confounds the two."""
    net = BayesianNetwork([("rf", "ls"), ("rf", "disc"), ("ls", "disc")]).fit(coded(spark, sf).select("rf", "ls", "disc"))
    return rounded(causal.do_query(net, ["disc"], {"ls": "F"}).df)


@query("""WITH c AS (SELECT covar_samp(l_quantity, l_extendedprice) AS xy, covar_samp(l_partkey, l_extendedprice) AS zy, covar_samp(l_quantity, l_partkey) AS xz, var_samp(l_quantity) AS xx, var_samp(l_partkey) AS zz FROM lineitem)
SELECT round((xy * zz - zy * xz) / (xx * zz - xz * xz), 3) AS ate FROM c""")
def estimate_ate(spark, sf):
    dag = DAG([("l_partkey", "l_quantity"), ("l_partkey", "l_extendedprice"), ("l_quantity", "l_extendedprice")])
    data = lineitem(spark, sf).select("l_partkey", "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(causal.estimate_ate(dag, data, "l_quantity", "l_extendedprice"), 3),)], "ate double")


_CORRECTED = " UNION ALL ".join(f"SELECT '{x}' AS u, '{y}' AS v, sum(pow(greatest(abs(o - x * y / t) - 0.5, 0), 2) / (x * y / t)) AS s FROM (SELECT g.{x}, h.{y}, coalesce(n.n, 0) AS o, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.{x}) AS x, sum(coalesce(n.n, 0)) OVER (PARTITION BY h.{y}) AS y, sum(coalesce(n.n, 0)) OVER () AS t FROM (SELECT DISTINCT {x} FROM planted) g CROSS JOIN (SELECT DISTINCT {y} FROM planted) h LEFT JOIN (SELECT {x}, {y}, CAST(count(*) AS DOUBLE) AS n FROM planted GROUP BY ALL) n ON n.{x} = g.{x} AND n.{y} = h.{y})" for x, y in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")))


@query(f"""WITH {PLANTED}, s AS ({_CORRECTED}), r AS (SELECT s < 3.841458820694124 AS t, (u, v) IN (('a', 'd'), ('b', 'd')) AS f FROM s)
SELECT CASE WHEN count(*) FILTER (t AND f) = 0 THEN 0.0 ELSE round(CAST(2 * count(*) FILTER (t AND f) AS DOUBLE) / (count(*) FILTER (t) + count(*) FILTER (f)), 6) END AS f1 FROM r""")
def correlation_score(spark, sf):
    dag = DAG([("a", "b"), ("a", "c"), ("d", "c")])
    return spark.createDataFrame([(round(float(metrics.correlation_score(dag, citests.CITests(planted(spark, sf)))), 6),)], "f1 double")


@query("WITH c AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS v, regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem) SELECT round(-n / 2 * ln(2 * pi() * v * (1 - r)) - n / 2 - 1.5 * ln(n), 2) AS score FROM c")
def bic_gaussian_score(spark, sf):
    s = scores.GaussianScore(lineitem(spark, sf).select("l_extendedprice", "l_quantity"), "bic-g")
    return spark.createDataFrame([(round(s.local("l_extendedprice", ["l_quantity"]), 2),)], "score double")


def _round_trip(name: str, write: Callable, read: Callable) -> None:
    def run(spark, sf):
        data = coded(spark, sf).select(F.col("rf"), F.col("ls"), F.concat(F.lit("d"), F.col("disc").cast("string")).alias("disc"))
        net = BayesianNetwork([("rf", "ls"), ("disc", "ls")]).fit(data)
        return rounded(read(write(models.Spec.of(net))).network(spark).cpds["ls"].df.select("ls", "rf", "disc", VALUE))

    run.__name__ = f"{name}_round_trip"
    query(f"WITH {CODED} SELECT ls, rf, 'd' || CAST(disc AS VARCHAR) AS disc, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rf, disc), 6) AS value FROM coded GROUP BY ls, rf, disc")(run)


_round_trip("xmlbif", models.write_xmlbif, models.read_xmlbif)
_round_trip("net", models.write_net, models.read_net)
_round_trip("xbn", models.write_xbn, models.read_xbn)


@query(f"""WITH {CODED}, v AS (SELECT DISTINCT ls, rf FROM (SELECT DISTINCT ls FROM coded), (SELECT DISTINCT rf FROM coded)) SELECT v.ls, v.rf, coalesce(n, 0) AS n FROM v LEFT JOIN (SELECT ls, rf, count(*) AS n FROM coded GROUP BY ls, rf) USING (ls, rf)""")
def state_counts_cartesian(spark, sf):
    data = coded(spark, sf)
    return state_counts(data, "ls", ["rf"], states=state_names(data, ["ls", "rf"])).select("ls", "rf", F.col("n").cast("long").alias("n"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """P(line status | high discount) in a network learned from lineitem."""
    return ve_query(spark, sf)


