"""Exact deduplication with a log-structured merge index of digests.

1. Every task feeds the digests of its texts to a memtable. A full memtable is flushed as a sorted run with a Bloom
   filter; a digest that an older run already holds is counted there. Runs of one level are merged to a run of the next;
   beyond a bound the merged run leaves the task. So a text that fills a third of the table leaves a few rows per task.
2. Compaction merges the runs of all tasks by digest: the surviving identifier and the number of rows.
3. A filter over the digests that occur more than once, of bounded size, tells which rows are unique. The texts of the
   others are verified: they are grouped by digest and bytes, each task sending a text once however many copies it has.
4. Rows get the result of their digest. Digests with more than a ten-thousandth of all copies are at most ten thousand and
   are joined where the rows are; the others by a shuffle of rows without their text.
5. Rows of a digest that several texts share are grouped again by the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm import bloom
from credalis.llm import kernel as K
from credalis.llm.skew import joined
from credalis.llm.store import dropped, saved, shielded, table

#: Rows of a memtable, and digests that a task holds in runs.
MEMTABLE_ROWS, HELD_ROWS = 1 << 16, 1 << 19


@dataclass
class Run:
    """A sorted run: distinct digests (fixed-width bytes), surviving ids (where ``known``), counts and a Bloom filter over the digests."""

    digests: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    counts: np.ndarray
    filter: np.ndarray
    level: int = 0

    @classmethod
    def of(cls, digests: np.ndarray, ids: np.ndarray, known: np.ndarray, counts: np.ndarray, level: int = 0) -> Run:
        return cls(digests, ids, known, counts, bloom.build(prefixes(digests), bloom.bits_for(len(digests))), level)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Positions of the digests in this run, -1 where absent; the filter is asked first."""
        at = np.full(len(digests), -1)
        maybe = np.flatnonzero(bloom.contains(self.filter, prefixes(digests)))
        if len(maybe):
            pos = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            at[maybe] = np.where(self.digests[pos] == digests[maybe], pos, -1)
        return at


def prefixes(digests: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each digest, mixed to a number; short digests are padded with zeros."""
    width = max(16, digests.dtype.itemsize)
    raw = np.ascontiguousarray(digests.astype(f"S{width}")).view(np.uint8).reshape(len(digests), width)[:, :16]
    halves = np.ascontiguousarray(raw).view(">u8").astype(np.uint64)
    return K.mix(halves[:, 0] * np.uint64(0x9E3779B97F4A7C15) + halves[:, 1])


def merged(a: Run, b: Run) -> Run:
    """Of two sorted runs that share no digest."""
    at = np.searchsorted(a.digests, b.digests) + np.arange(len(b.digests))
    first = np.ones(len(a.digests) + len(b.digests), bool)
    first[at] = False

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), x.dtype)
        out[first], out[at] = x, y
        return out

    return Run.of(both(a.digests, b.digests), both(a.ids, b.ids), both(a.known, b.known), both(a.counts, b.counts), max(a.level, b.level) + 1)


class MergeIndex:
    """Memtable and runs of one task. Ids are numbers; rows without one (``known`` is false) lose against any id."""

    def __init__(self, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS, held_rows: int = HELD_ROWS):
        self.best = {"min": np.minimum, "max": np.maximum}[keep]
        self.worst = {"min": (1 << 63) - 1, "max": -(1 << 63)}[keep]
        self.memtable_rows, self.held_rows = memtable_rows, held_rows
        self.memtable: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0
        self.runs: list[Run] = []

    def put(self, digests: np.ndarray, ids: np.ndarray, known: np.ndarray) -> Iterator[Run]:
        """Takes rows; gives back what leaves the task."""
        for lo in range(0, len(digests), self.memtable_rows):
            part = slice(lo, lo + self.memtable_rows)
            self.memtable.append((digests[part], np.where(known[part], ids[part], self.worst), known[part]))
            self.rows += len(digests[part])
            if self.rows >= self.memtable_rows:
                self.flush()
            if sum(len(r.digests) for r in self.runs) > self.held_rows:
                yield from self.compacted()

    def flush(self) -> None:
        if not self.rows:
            return
        digests, ids, known = (np.concatenate(x) for x in zip(*self.memtable, strict=True))
        self.memtable, self.rows = [], 0
        order = np.argsort(digests, kind="stable")
        digests, ids, known = digests[order], ids[order], known[order]
        begin = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1])))
        counts = np.diff(np.concatenate((begin, [len(digests)])))
        digests, ids, known = digests[begin], self.best.reduceat(ids, begin), np.logical_or.reduceat(known, begin)
        fresh = np.ones(len(digests), bool)
        for run in self.runs:
            at = run.find(digests)
            own = np.flatnonzero(at >= 0)
            run.ids[at[own]] = self.best(run.ids[at[own]], ids[own])
            run.known[at[own]] |= known[own]
            run.counts[at[own]] += counts[own]
            fresh[own] = False
        if fresh.any():
            self.runs.append(Run.of(digests[fresh], ids[fresh], known[fresh], counts[fresh]))
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(merged(a, b))

    def compacted(self) -> Iterator[Run]:
        """All runs as one, sorted by digest; the index is empty then."""
        self.flush()
        while len(self.runs) > 1:
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(merged(a, b))
        if self.runs:
            yield self.runs.pop()


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, hex; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def digest_index(rows: DataFrame, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """``(key, keep_id, group_size)``, one row per distinct key of ``rows(id, key)``."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex(keep, memtable_rows, held_rows)

        def out(found: Iterator[Run]) -> Iterator[pa.RecordBatch]:
            for run in found:
                for k in range(0, len(run.digests), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.record_batch([pa.array(run.digests[part].astype(str)), pa.array(run.ids[part], pa.int64(), mask=~run.known[part]), pa.array(run.counts[part], pa.int64())], ["key", "keep_id", "group_size"])

        for b in batches:
            ids = b.column(0)
            keys = np.array(b.column(1).to_pylist(), "S")
            yield from out(index.put(keys, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))
        yield from out(index.compacted())

    best = F.max if keep == "max" else F.min
    found = rows.select("id", "key").mapInArrow(runs, "key string, keep_id long, group_size long")
    return found.groupBy("key").agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def among(spark: SparkSession, keys: DataFrame, of: str) -> Column:
    """Whether the hash of a column may be among ``keys(of)``: a Bloom filter of bounded size."""
    bits = spark.sparkContext.broadcast(bloom.build_distributed(keys, *bloom.halves(F.xxhash64(of))))
    return F.arrow_udf(lambda h: pa.array(bloom.contains(np.frombuffer(bits.value, np.uint8), h.to_numpy().view(np.uint64)), pa.bool_()), "boolean")


@dataclass
class Groups:
    """What is known of the texts that may occur more than once."""

    repeated: Column  # a function of the hash of a key: whether the key may occur more than once
    groups: DataFrame  # (key, texts, keep_id, group_size) of such keys
    odd: bool  # whether a key has several texts
    index: DataFrame


def _verified(docs: DataFrame, rows: DataFrame, keep: str, width: int, text: str, memtable_rows: int, held_rows: int) -> Groups:
    """``rows(id, key)`` are those of ``docs``."""
    best = F.max if keep == "max" else F.min
    index = saved(digest_index(rows, keep, memtable_rows, held_rows).filter("group_size > 1"), "digests")
    repeated = among(docs.sparkSession, index, "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.substring(digest_of(F.col(text)), 1, 2 * width).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).filter(repeated(F.xxhash64("key")))
    groups = texts.groupBy("key", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"), best("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = saved(groups, "groups")
    return Groups(repeated, groups, not groups.filter("texts > 1").isEmpty(), index)


def _by_text(docs: DataFrame, found: Groups, keep: str, width: int, text: str) -> DataFrame:
    """The rows of ``docs`` whose digest several texts share, with ``key``, ``digest``, ``keep_id`` and ``group_size`` by the text."""
    best = F.max if keep == "max" else F.min
    odd = found.groups.filter("texts > 1").select("key")
    rows = docs.withColumns({"digest": digest_of(F.col(text)), "body": F.coalesce(F.col(text).cast("string"), F.lit(""))}).withColumn("key", F.substring("digest", 1, 2 * width)).join(odd, "key", "left_semi")
    sums = rows.groupBy("body").agg(best(F.col("doc_id").cast("long")).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(sums, "body").drop("body")


def exact_groups(docs: DataFrame, keep: str = "min", width: int = 32, text: str = "text", memtable_rows: int = MEMTABLE_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """``(doc_id, keep_id, group_size, digest)``, one row for each row of ``docs(doc_id, text)``; ``digest`` is the full SHA-256, hex.

    Null text counts as empty. A null ``doc_id`` survives only if its whole group has none. Repeated rows count each;
    rows that share the surviving id all carry it. ``width``: bytes of SHA-256 that the index keys use (a test may
    shorten it to force equal digests of different texts). An empty table gives an empty result. Other columns are not
    read. Texts are read twice, and only those that may be repeated are shuffled.
    """
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("id"), digest_of(docs[text]).alias("digest")).withColumn("key", F.substring("digest", 1, 2 * width)), "rows")
    found = _verified(docs, rows, keep, width, text, memtable_rows, held_rows)
    rows = rows.withColumn("maybe", found.repeated(F.xxhash64("key")))
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    unique = rows.filter("not maybe").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    out = unique.unionByName(joined(rows.filter("maybe").drop("maybe"), found.groups.filter("texts = 1").withColumn("rows", F.col("group_size")).drop("texts"), ["key"], "rows", ["id"]).withColumnRenamed("id", "doc_id").select(*columns))
    if found.odd:
        out = out.unionByName(_by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs[text].alias(text)), found, keep, width, text).select(*columns))
    dropped(found.index)
    return out


def drop_exact_copies(docs: DataFrame, keep: str = "min", text: str = "text", width: int = 32) -> DataFrame:
    """``docs`` with its own columns, whatever their names, without copies: of equal texts the row with the smallest
    (``keep="max"``: largest) ``doc_id`` stays, and one row of those that repeat it.

    Null text counts as empty; a row without doc_id stays only if its whole group has none. Unique rows are not shuffled,
    and of a group's rows only the survivor. An empty table gives an empty result.
    """
    return shielded(docs, ("doc_id", text), lambda d: _drop_exact_copies(d, keep, text, width))


def _drop_exact_copies(docs: DataFrame, keep: str, text: str, width: int) -> DataFrame:
    names = docs.columns
    key = F.substring(digest_of(docs[text]), 1, 2 * width)
    found = _verified(docs, docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key")), keep, width, text, MEMTABLE_ROWS, HELD_ROWS)
    dropped(found.index)
    own = F.xxhash64("key", F.col("doc_id").cast("long"))
    keepers = found.groups.filter("texts = 1").select("key", F.col("keep_id").alias("doc_id"))
    survives = among(docs.sparkSession, keepers.select(F.xxhash64("key", "doc_id").alias("h")), "h")
    rows = docs.withColumn("key", key).withColumns({"maybe": found.repeated(F.xxhash64("key")), "survives": survives(F.xxhash64(own))})
    unique = rows.filter("not maybe").select(*names)
    some = rows.filter("maybe and survives").drop("maybe", "survives")
    held = keepers.select(F.col("key").alias("_key"), F.col("doc_id").alias("_keep"))
    stay = some.join(held, (F.col("key") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_keep"))).dropDuplicates(["key"])
    out = unique.unionByName(stay.select(*names))
    if found.odd:
        left = _by_text(docs, found, keep, width, text).filter(F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")))
        out = out.unionByName(left.dropDuplicates(["digest"]).select(*names))
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all rows of ``documents``; the largest doc_id stays. Null counts as empty text; rows without
    doc_id lose against any; repeated rows each give their row; extra columns are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_groups(docs, keep="max")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
