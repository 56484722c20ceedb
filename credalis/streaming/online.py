"""Structured Streaming: parameters that follow a stream, and beliefs that follow entities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from credalis.operators.factors import CPD, VALUE, q


def streaming_counts(events: DataFrame, family: Sequence[str]) -> DataFrame:
    """Running counts of a family: its states and ``n``; for the update or complete mode. Rows with nulls in the family don't count."""
    return events.dropna(subset=list(family)).groupBy(*map(q, family)).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, family: Sequence[str], time: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window, slide), *map(q, family)).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), q(key)).agg(F.count(F.lit(1)).alias("n"))


def cpd_of_counts(counts: DataFrame, variable: str, parents: Sequence[str], states: dict[str, list], alpha: float = 0.0) -> CPD:
    """The table that counts ``(family..., n)`` give, on the full grid."""
    from pyspark.sql import Window

    from credalis.operators.factors import grid

    family = [variable, *parents]
    full = grid(counts.sparkSession, family, states).join(counts, family, "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(float(alpha)))
    total = F.sum("n").over(Window.partitionBy(*map(q, parents)))
    return CPD(full.select(*map(q, family), F.when(total > 0, F.col("n") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / len(states[variable])).alias(VALUE)), variable, list(parents), states)


class BeliefFilter(StatefulProcessor):
    """Keeps the belief over a hidden state of each entity: one transition and one observation for each event, in order of time
    within a batch. State is one vector for each key."""

    def __init__(self, start: np.ndarray, transition: np.ndarray, emission: np.ndarray, symbols: list, key: str, time: str, symbol: str):
        self.start, self.transition, self.emission, self.symbols = start, transition, emission, symbols
        self.key, self.time, self.symbol = key, time, symbol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("belief", T.StructType([T.StructField("p", T.ArrayType(T.DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        belief = np.array(self.state.get()[0]) if self.state.exists() else None
        frame = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        for s in frame[self.symbol]:
            belief = step(belief, self.start, self.transition, self.emission, self.symbols.index(s) if s in self.symbols else None)
        self.state.update((belief.tolist(),))
        yield pd.DataFrame({self.key: [key[0]], "belief": [belief.tolist()], "events": [len(frame)]})

    def close(self) -> None:
        """No resources."""


def step(belief: np.ndarray | None, start: np.ndarray, transition: np.ndarray, emission: np.ndarray, symbol: int | None) -> np.ndarray:
    """Predict, then weigh by the symbol; an unknown symbol tells nothing."""
    out = start if belief is None else belief @ transition
    if symbol is not None:
        out = out * emission[:, symbol]
    return out / out.sum()


def filtered(events: DataFrame, key: str, time: str, symbol: str, start: Sequence[float], transition: Sequence[Sequence[float]], emission: Sequence[Sequence[float]], symbols: Sequence) -> DataFrame:
    """``(key, belief, events)`` after each batch, for the update mode; needs the RocksDB state store."""
    processor = BeliefFilter(np.asarray(start, float), np.asarray(transition, float), np.asarray(emission, float), list(symbols), key, time, symbol)
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("belief", T.ArrayType(T.DoubleType())), T.StructField("events", T.LongType())])
    return events.select(q(key), q(time), q(symbol)).groupBy(q(key)).transformWithStateInPandas(processor, schema, "Update", "None")


def filtered_batch(events: DataFrame, key: str, time: str, symbol: str, start: Sequence[float], transition: Sequence[Sequence[float]], emission: Sequence[Sequence[float]], symbols: Sequence) -> DataFrame:
    """The same over a table: one fold over each entity's ordered events, as a column expression."""
    k = len(start)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(q(time), q(symbol).alias("s")))), lambda x: x["s"])
    rows = events.groupBy(q(key)).agg(ordered.alias("_s"))
    number = F.array(*[F.lit(s) for s in symbols])
    e = F.array(*[F.array(*[F.lit(float(emission[i][j])) for j in range(len(symbols))]) for i in range(k)])

    def weigh(p: list, s):
        at = F.array_position(number, s)
        raw = [p[i] * F.when(at > 0, F.element_at(e[i], F.greatest(at, F.lit(1)).cast("int"))).otherwise(1.0) for i in range(k)]
        total = sum(raw[1:], raw[0])
        return F.array(*[r / total for r in raw])

    first = weigh([F.lit(float(x)) for x in start], F.element_at("_s", 1))

    def move(a, s):
        return weigh([sum((a[j] * F.lit(float(transition[j][i])) for j in range(1, k)), a[0] * F.lit(float(transition[0][i]))) for i in range(k)], s)

    return rows.select(q(key), F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), first, move).alias("belief"), F.size("_s").cast("long").alias("events"))
