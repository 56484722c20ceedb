"""Mixing sources to target weights by Pfair scheduling.

Each source is dealt into blocks. With weight ``w``, its block ``j`` (from 0) may run from slot ``floor(j / w)`` and is
due by slot ``ceil((j + 1) / w)``; earliest deadline first meets every deadline, so at any slot each source is less than
one block away from its target. Weights are exact fractions, never rounded to slots, so nothing adds up over a long
schedule. The driver goes through the slots once, one for each block; the schedule joins the rows by source and block.

A source that runs out ends a phase; the others go on by their weights among themselves. No row is dropped or repeated.

The time for phases grows with the square of the sources. With more than ``MAX_SOURCES`` of them the largest half of that
number are scheduled as they are, and the rest in as many groups as sources of their joint weight; each group is scheduled
within itself in the same way, in a task of its own. A small source is then less than one block of its group, and the group
less than one block of the mix, from the target.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credalis.llm.store import saved, shielded, table

#: Blocks of a source that one row of the schedule holds.
PERIOD = 1000
#: A schedule of at most so many blocks (8 MB of slots) is broadcast, a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000
BLOCK_DOCS = 16
#: Rows that are ranked in one group, while there are no more than MAX_GROUPS groups of a source.
GROUP_ROWS = 1000
MAX_GROUPS = 20_000
#: Sources and groups of sources that one schedule holds; it starts a phase for each that runs out.
MAX_SOURCES = 2000


def whole(weights: list[float]) -> list[int]:
    """Integers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact))
    return [int(x * common) for x in exact]


def schedule(weights: list[int], left: list[int]) -> list[list[int]]:
    """For each source with that weight and that many blocks, the slots it gets until one runs out: earliest deadline first among the released."""
    total = sum(weights)
    out: list[list[int]] = [[] for _ in weights]
    ready = [(-(-total // w), i) for i, w in enumerate(weights)]
    heapq.heapify(ready)
    # a block is released after the one before it has run, so one block of each source is in either heap
    waiting: list[tuple[int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * total // weights[i]), i))
        i = heapq.heappop(ready)[1]
        out[i].append(t)
        if len(out[i]) == left[i]:
            return out
        heapq.heappush(waiting, (len(out[i]) * total // weights[i], i))
        t += 1


@dataclass
class Part:
    """Blocks ``first`` to ``last`` (exclusive) of a source in the phase that begins at slot ``start``: block ``first + k`` gets
    slot ``start + at[k]``. ``period``: the slots, not whole, that so many blocks take at the target weight."""

    source: str | None
    first: int
    last: int
    start: int
    period: float
    at: list[int]


def phases(blocks: dict[str | None, int], weights: dict[str | None, float] | None, period: int = PERIOD) -> list[Part]:
    """The schedule of all blocks; the blocks of a part have the same ``block // period``. Sources without a weight, or with 0,
    follow when the others have run out."""
    left = {s: n for s, n in sorted(blocks.items(), key=lambda x: (x[0] is None, x[0] or "")) if n > 0}
    done = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        weight = {s: max(0.0, (weights or {}).get(s, 0.0)) for s in left}
        active = [s for s in left if weight[s] > 0] or list(left)
        exact = whole([weight[s] or 1.0 for s in active])
        total = sum(exact)
        for s, w, at in zip(active, exact, schedule(exact, [left[s] for s in active]), strict=True):
            first, end = done[s], done[s] + len(at)
            while done[s] < end:
                last = min(end, (done[s] // period + 1) * period)
                own = at[done[s] - first : last - first]
                out.append(Part(s, done[s], last, start, float(Fraction(len(own) * total, w)), own))
                done[s] = last
            left[s] -= len(at)
            if left[s] == 0:
                del left[s]
        start = sum(done.values())
    return out


def smoothed(counts: dict[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights by size to a power, which lifts small sources."""
    total = sum(n**power for n in counts.values()) or 1.0
    return {s: n**power / total for s, n in counts.items()}


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``slot`` (of the block in the mix) and ``place`` (in the block) added; ``(slot, place)`` orders the mix.

    Within a source, documents are dealt into blocks by a hash of doc_id. Without ``weights``, sources are weighted by the
    square root of their size. Null is a source of its own. Repeated rows each have a place; which of two rows with the
    same doc_id comes first doesn't matter. The last block of a source may be short. An empty table gives an empty
    result. Texts are not read. Columns named like the added ones are replaced.
    """
    docs = docs.drop("block", "slot", "place")
    return shielded(docs, ("doc_id", source), lambda d: _mixed(d, weights, source, block_docs, period))


_PLAN = "_p string, _part long, _first long, _last long, _start long, _at array<long>"


def _rows(parts: list[Part], period: int) -> list[tuple]:
    return [(p.source, p.first // period, p.first, p.last, p.start, p.at) for p in parts]


def _slotted(rows: DataFrame, name: str, block: str, plan: DataFrame, n_blocks: int, period: int, out: str) -> DataFrame:
    """``rows`` with the slot that the plan gives to the block ``block`` of the source ``name``."""
    # 8 bytes a block
    plan = F.broadcast(plan) if n_blocks <= BROADCAST_BLOCKS else plan
    own = F.col(name).eqNullSafe(F.col("_p")) & (F.floor(F.col(block) / period).cast("long") == F.col("_part"))
    placed = rows.join(plan, own & (F.col(block) >= F.col("_first")) & (F.col(block) < F.col("_last")))
    # null out of bounds: the optimizer may ask before it has dropped the other parts
    slot = F.col("_start") + F.get("_at", (F.col(block) - F.col("_first")).cast("int"))
    return placed.withColumn(out, slot.cast("long")).drop("_p", "_part", "_first", "_last", "_start", "_at")


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, source: str, block_docs: int, period: int) -> DataFrame:
    spark = docs.sparkSession
    each = docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    top = each.orderBy(F.desc("n"), F.asc_nulls_last("s")).limit(MAX_SOURCES + 1).collect()
    counts = {r.s: r.n for r in top}
    n_groups = min(MAX_GROUPS, max(1, -(-max(counts.values(), default=0) // GROUP_ROWS)))
    h: Column = F.xxhash64("doc_id")
    keyed = docs.withColumn("_s", F.col(source).cast("string")).withColumn("_h", h).withColumn("_g", F.pmod(F.shiftrightunsigned(F.col("_h"), 20), F.lit(n_groups)).cast("int"))
    sizes = keyed.groupBy("_s", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_s").orderBy("_g")) - F.col("_n")).select("_s", "_g", "_before")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_h", "doc_id")) - 1)
    # at most MAX_GROUPS rows a source
    ranked = ranked.join(before.select(F.col("_s").alias("_s2"), F.col("_g").alias("_g2"), "_before"), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_g") == F.col("_g2")))
    rank = F.col("_before") + F.col("_r")
    blocked = ranked.withColumn("block", F.floor(rank / block_docs).cast("long")).withColumn("place", F.pmod(rank, F.lit(block_docs)).cast("int"))
    if len(counts) <= MAX_SOURCES:
        blocks = {s: -(-n // block_docs) for s, n in counts.items()}
        plan = spark.createDataFrame(_rows(phases(blocks, weights if weights is not None else smoothed(counts), period), period), _PLAN)
        out = _slotted(blocked, "_s", "block", plan, sum(blocks.values()), period, "slot")
    else:
        out = _grouped(blocked, each, weights, [r.s for r in top[: MAX_SOURCES // 2]], block_docs, period)
    return out.select(*docs.columns, "block", "slot", "place")


def _grouped(blocked: DataFrame, each: DataFrame, weights: dict[str | None, float] | None, large: list[str | None], block_docs: int, period: int) -> DataFrame:
    """More sources than one schedule holds: the ``large`` ones and groups of the others."""
    spark = blocked.sparkSession
    own = spark.createDataFrame([(s,) for s in large], "_l string")
    # the names of at most MAX_SOURCES / 2 sources are broadcast
    named = each.join(F.broadcast(own), F.col("s").eqNullSafe(F.col("_l")) if None in large else F.col("s") == F.col("_l"), "left")
    is_large = F.col("_l").isNotNull() | (F.col("s").isNull() if None in large else F.lit(False))
    group = F.when(is_large, F.lit(None)).otherwise(F.pmod(F.xxhash64("s"), F.lit(max(1, MAX_SOURCES // 2))).cast("string"))
    some = F.lit(None).cast("double")
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_w string, _weight double")
        named, some = named.join(given, F.col("s").eqNullSafe(F.col("_w")), "left"), F.coalesce("_weight", F.lit(0.0))
    else:
        some = F.sqrt("n")
    units = named.select("s", group.alias("g"), F.ceil(F.col("n") / block_docs).cast("long").alias("b"), F.greatest(some, F.lit(0.0)).alias("w"), is_large.alias("large"))

    def plan_of(frame: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(s) else s for s in frame["s"]]
        parts = phases(dict(zip(names, map(int, frame["b"]), strict=True)), dict(zip(names, map(float, frame["w"]), strict=True)), period)
        return pd.DataFrame(_rows(parts, period), columns=["_p", "_part", "_first", "_last", "_start", "_at"])

    small = saved(units.filter(~F.col("large")).groupBy("g").applyInPandas(plan_of, _PLAN), "groups")
    totals = units.groupBy("large", "g", F.when(F.col("large"), F.col("s")).alias("s")).agg(F.sum("b").alias("b"), F.sum("w").alias("w")).collect()
    name = {(r.large, r.s if r.large else r.g): f"{'s' if r.large else 'g'}{'' if (r.s if r.large else r.g) is None else ':' + (r.s if r.large else r.g)}" for r in totals}
    blocks = {name[r.large, r.s if r.large else r.g]: r.b for r in totals}
    plan = spark.createDataFrame(_rows(phases(blocks, {name[r.large, r.s if r.large else r.g]: r.w for r in totals}, period), period), _PLAN)
    flag = blocked.join(F.broadcast(own), F.col("_s").eqNullSafe(F.col("_l")), "left")
    far = F.col("_l").isNotNull() | (F.col("_s").isNull() if None in large else F.lit(False))
    first = flag.filter(far).withColumns({"_unit": F.coalesce(F.concat(F.lit("s:"), F.col("_s")), F.lit("s")), "_in": F.col("block")}).drop("_l")
    inner = _slotted(flag.filter(~far).drop("_l"), "_s", "block", small, BROADCAST_BLOCKS + 1, period, "_in")
    rest = inner.withColumn("_unit", F.concat(F.lit("g:"), F.pmod(F.xxhash64("_s"), F.lit(max(1, MAX_SOURCES // 2))).cast("string")))
    return _slotted(first.unionByName(rest), "_unit", "_in", plan, sum(blocks.values()), period, "slot")


def in_order(docs: DataFrame) -> DataFrame:
    """The rows of ``mixed`` laid out in the order of the mix: range partitions, each sorted."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row of ``documents`` in the mix of its sources. Null is a source of its own; repeated rows each have a place;
    an empty table gives an empty result; extra columns are not read."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
