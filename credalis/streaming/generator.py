"""Endless samples of a network as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.operators.factors import q
from credalis.operators.network import BayesianNetwork


def sample_stream(spark: SparkSession, net: BayesianNetwork, rows_per_second: int = 100, seed: int = 0) -> DataFrame:
    """``(timestamp, variables...)``: forward samples at a steady rate. A row's values follow from its number, so a batch that
    runs again gives the same rows; tables join as static sides."""
    out = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("value", "_id")
    for i, v in enumerate(net.dag.topological()):
        out = net.draw(out, net.cpds[v], seed + i, v)
    return out.select(F.col("timestamp"), *map(q, net.nodes))
