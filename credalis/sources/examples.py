"""Small well-known networks, by name. The published tables, one row for each state, last parent fastest."""

from __future__ import annotations

from pyspark.sql import SparkSession

from credalis.operators.factors import CPD
from credalis.operators.network import BayesianNetwork

YES_NO = ["yes", "no"]

NETWORKS: dict[str, dict[str, tuple[list[str], list[str], list[list[float]]]]] = {
    "asia": {
        "asia": (YES_NO, [], [[0.01], [0.99]]),
        "smoke": (YES_NO, [], [[0.5], [0.5]]),
        "tub": (YES_NO, ["asia"], [[0.05, 0.01], [0.95, 0.99]]),
        "lung": (YES_NO, ["smoke"], [[0.1, 0.01], [0.9, 0.99]]),
        "bronc": (YES_NO, ["smoke"], [[0.6, 0.3], [0.4, 0.7]]),
        "either": (YES_NO, ["lung", "tub"], [[1, 1, 1, 0], [0, 0, 0, 1]]),
        "xray": (YES_NO, ["either"], [[0.98, 0.05], [0.02, 0.95]]),
        "dysp": (YES_NO, ["bronc", "either"], [[0.9, 0.8, 0.7, 0.1], [0.1, 0.2, 0.3, 0.9]]),
    },
    "cancer": {
        "Pollution": (["low", "high"], [], [[0.9], [0.1]]),
        "Smoker": (["True", "False"], [], [[0.3], [0.7]]),
        "Cancer": (["True", "False"], ["Pollution", "Smoker"], [[0.03, 0.001, 0.05, 0.02], [0.97, 0.999, 0.95, 0.98]]),
        "Xray": (["positive", "negative"], ["Cancer"], [[0.9, 0.2], [0.1, 0.8]]),
        "Dyspnoea": (["True", "False"], ["Cancer"], [[0.65, 0.3], [0.35, 0.7]]),
    },
    "sprinkler": {
        "Cloudy": (YES_NO, [], [[0.5], [0.5]]),
        "Sprinkler": (YES_NO, ["Cloudy"], [[0.1, 0.5], [0.9, 0.5]]),
        "Rain": (YES_NO, ["Cloudy"], [[0.8, 0.2], [0.2, 0.8]]),
        "Wet": (YES_NO, ["Rain", "Sprinkler"], [[0.99, 0.9, 0.9, 0.0], [0.01, 0.1, 0.1, 1.0]]),
    },
}


def example(spark: SparkSession, name: str) -> BayesianNetwork:
    if name not in NETWORKS:
        raise ValueError(f"no network {name!r}; there are {sorted(NETWORKS)}")
    tables = NETWORKS[name]
    net = BayesianNetwork([(p, v) for v, (_, ps, _) in tables.items() for p in ps], tables)
    return net.add_cpds(*[CPD.table(spark, v, rows, ps, {n: tables[n][0] for n in (v, *ps)}) for v, (_, ps, rows) in tables.items()])
