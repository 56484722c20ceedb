"""MinHash near-deduplication with tensored banding.

Each text has a few small collections of minhashes (bands of ``BAND`` values). Its table keys are all pairs of bands,
so ``BANDS`` bands give ``BANDS * (BANDS - 1) / 2`` tables of ``2 * BAND`` values each from about the square root of
the minhash work. Two texts meet unless fewer than two bands agree: at similarity 0.8 that is 1.6 in 100,000.

Texts with equal shingle sets are one class from the start. The classes that share a key are linked in two steps:

1. each is compared with the smallest id of the key (one link to test for each member, however large the group);
   the links that hold on the full sets join into components;
2. keys whose members are still in several components are searched fully: small ones pair by pair across components;
   the members of large ones meet again by the first of the key's two bands, in blocks of bounded size inside one task,
   which emits no more links than it has members.

No bucket is capped. Exact set sizes are compared first, since the smaller set must have 80 % of the larger. Keys, hubs and
classes with more than a ten-thousandth of all rows are joined where their rows are (``skew``).

Sets are sets of 64-bit hashes of shingles, which every link is confirmed on; classes are told by the size and a 128-bit
digest of the whole sorted set. Two texts of 10,000 shingles each have a common hash of different shingles once in 10^11 pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm import bloom
from credalis.llm import kernel as K
from credalis.llm.skew import joined
from credalis.llm.store import dropped, saved, shielded, table

BANDS = 14
BAND = 2
#: Keys of at most so many classes are searched pair by pair.
SMALL = 16
#: A block of a large key holds at most so many classes and bytes of shingles.
BLOCK_SETS = 4096
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(7919)
_FLIP = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)
_SPREAD = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """The bands of each non-empty set, as an array of shape (sets, BANDS)."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros((len(sets), BANDS), np.uint64)
    for f in range(BANDS * BAND):
        least = np.minimum.reduceat((every ^ _FLIP[f]) * _SPREAD[f], starts)
        out[:, f // BAND] = K.mix(out[:, f // BAND] * np.uint64(31) + least)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, bands)`` of each row; the digest of the sorted set (two numbers) tells equal sets. Bands are empty for empty sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.text_buffers(b.column(1))
            for i, j in K.slices(offsets):
                sets = K.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                full = [n for n, s in enumerate(sets) if len(s)]
                bands, sums = np.zeros((0, BANDS), np.uint64), np.zeros((2, j - i), np.uint64)
                if full:
                    some = [sets[n] for n in full]
                    bands = band_values(some)
                    sums[:, full] = np.frombuffer(b"".join([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in some]), np.uint64).reshape(-1, 2).T
                has = np.zeros(j - i, bool)
                has[full] = True
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has) * BANDS)).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_table(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(node, set)`` for the rows of ``docs`` whose doc_id is in ``nodes(node)``, and perhaps a few others: a filter of
    bounded size picks the rows in the scan. A set is its sorted hashes as little-endian bytes."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build_distributed(nodes, *bloom.halves(F.xxhash64("node"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(bloom.contains(table_, b.column(1).to_numpy().view(np.uint64))))
            data, offsets = K.text_buffers(b.column(2))
            for i, j in K.slices(offsets):
                sets = K.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(scan, "node long, set binary")


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def _of(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u8")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are alike."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _of(x), _of(y)
                n = len(x) + len(y)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum()) if n else 0
                keep.append(n > 0 and bool(alike(common, len(x), len(y), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_y")), "b")
    return both.select("a", "b", "set_x", "set_y").mapInArrow(scan, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the smallest node reachable. Alternating large-star and
    small-star steps, each written to the shared folder; the number of rounds grows with the logarithm of the longest path."""
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
            out._credalis_path = e._credalis_path  # goes when it is dropped
            return out
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = saved(joined(both, least, ["a"], "n", ["b"], total=2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        near = large.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
        turned = joined(large, near.withColumnRenamed("b", "m"), ["a"], "n", ["b"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = saved(near.drop("n").unionByName(turned).distinct(), "edges")
        dropped(e, large)
        e = small


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block's nodes, at most one fewer than there are nodes."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate(([True], every[1:] != every[:-1]))
    token = np.cumsum(first) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    parent = {r: r for r in roots}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    if not len(token):
        return out
    token = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
    at = np.array(roots)
    step, high = max(256, (4 << 20) // n), max(64, (1 << 20) // n)
    for top in range(0, n, high):
        common = np.zeros((min(high, n - top), n), np.float32)
        for lo in range(0, int(token[-1]) + 1, step):
            a, b = np.searchsorted(token, [lo, lo + step])
            grid = np.zeros((n, step), np.float32)
            grid[owner[a:b], token[a:b] - lo] = 1
            common += grid[top : top + high] @ grid.T
        rows, cols = np.nonzero(alike(common, sizes[top : top + high, None], sizes[None, :], percent) & (at[top : top + high, None] != at[None, :]))
        for i, j in zip((rows + top).tolist(), cols.tolist(), strict=True):
            a, b = root(roots[i]), root(roots[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components of ``rows(key, node, root, n, c, s)`` (c classes and s shingles in the key), found in tasks
    that hold two blocks of a key at once."""
    n_blocks = F.greatest(F.ceil(F.col("c") / (BLOCK_SETS // 2)), F.ceil(F.col("s") * 8 / (BLOCK_BYTES // 2))).cast("int")
    n_blocks = F.when((F.col("c") <= BLOCK_SETS) & (F.col("s") * 8 <= BLOCK_BYTES), 1).otherwise(n_blocks)
    own = F.pmod(F.xxhash64("node", "key"), F.col("k")).cast("int")
    dealt = rows.withColumn("k", n_blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    full = dealt.select("key", "x", "y", "node", "root").join(sets, "node").select("key", "x", "y", "node", "root", "set")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one doc_id may differ in their text: a node has each of its sets
        def links(group: dict[tuple[int, bytes], int]) -> list[tuple[int, int]]:
            roots = list(group.values())
            return forest([n for n, _ in group], roots, [np.frombuffer(x, "<u8") for _, x in group], percent) if len(set(roots)) > 1 else []

        now, group, out = None, {}, []
        for b in batches:
            for key, x, y, node, root, raw in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (key, x, y) != now:
                    out += links(group)
                    now, group = (key, x, y), {}
                group[node, raw] = root
            if out:
                yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
                out = []
        if out := links(group):
            yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(scan, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    Documents are linked if their sets of ``k``-word shingles have a Jaccard similarity of ``percent`` / 100 or more;
    ``component_id`` is the smallest doc_id that links reach and ``kept`` marks it. A text with fewer words than ``k``
    is one shingle; null, empty or blank texts have none and are linked with nothing (their own component). Rows with
    the same doc_id are one node. A null doc_id takes the component of its equals, else null, and counts as kept there.
    An empty table gives an empty result; other columns are not read.
    """
    signed = sign = saved(signatures(docs, k), "signatures")
    classes = sign.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = saved(classes, "classes")
    pairs_of_bands = [(i, j) for i in range(BANDS) for j in range(i + 1, BANDS)]
    keys = classes.filter("node is not null").select("node", F.col("n_shingles").alias("n"), F.explode(F.array(*[F.struct(F.xxhash64(F.lit(t), F.col("bands")[i], F.col("bands")[j]).alias("key"), F.lit(i).cast("byte").alias("i")) for t, (i, j) in enumerate(pairs_of_bands)])).alias("k")).select("node", "n", "k.key", "k.i")
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter("c > 1")
    heads = saved(heads.withColumn("rows", F.col("c")), "heads")
    met = saved(joined(keys, heads, ["key"], "rows", ["node"]), "buckets")
    dropped(heads)

    sizes = classes.groupBy("node").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    star = met.filter("node <> head").select("node", "n", "head").distinct().join(sizes.withColumnRenamed("node", "head"), "head")
    star = saved(star.filter(F.col("n") * 100 >= F.col("least") * percent).filter(F.col("most") * 100 >= F.col("n") * percent).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    ends = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    sets = saved(shingle_table(docs, ends, k), "sets")
    links = saved(verified(star, sets, percent), "links")
    forest_ = components(links)
    first = saved(forest_, "components")
    dropped(sets, star, links, forest_)

    labelled = met.filter("c > 2").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi").drop("hi")
    rest = saved(joined(labelled, open_keys, ["key"], "rows", ["node"]).select("key", "i", "node", "root", "n", "c", "head"), "open")
    few = rest.filter((F.col("c") <= SMALL) & (F.col("node") != F.col("head")))
    other = few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("m"))
    pairs = few.withColumnRenamed("node", "a").join(other, "key").filter("a > b and root <> root_b").filter((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    bands = classes.filter("node is not null").select("node", "bands", F.col("n_shingles").alias("n"))
    large = rest.filter(F.col("c") > SMALL).select("node", "root", "i").distinct().join(bands, "node").select("node", "root", "n", F.xxhash64("i", F.element_at("bands", F.col("i").cast("int") + 1)).alias("key"))
    wide = large.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    large = saved(joined(large, wide.withColumn("rows", F.col("c")), ["key"], "rows", ["node"]), "wide")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    sets = saved(shingle_table(docs, ends, k), "sets")
    more = saved(verified(pairs, sets, percent).unionByName(_in_blocks(large, sets, percent)), "links")
    named = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    bridged = more.join(named, "a", "left").join(named.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    bridges = components(bridged.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    dropped(met, rest, pairs, large, sets, more)
    second = bridges.select(F.col("node").alias("root"), F.col("root").alias("top"))

    rooted = classes.select("set_a", "set_b", "n_shingles", "node", "rows").join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(second, "root", "left")
    rooted = saved(rooted.select("set_a", "set_b", "n_shingles", F.coalesce("top", "root").alias("component_id"), "rows"), "roots")
    dropped(classes, first, bridges)
    sign = sign.drop("bands")
    found = joined(sign.filter("n_shingles > 0"), rooted, ["set_a", "set_b", "n_shingles"], "rows", ["doc_id"], "left").select("doc_id", "n_shingles", "component_id")
    out = found.unionByName(sign.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out._credalis_reads = (signed, rooted)
    return out


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its own columns, whatever their names: of each group of near-duplicates the document with the smallest doc_id
    stays. Rows that repeat its doc_id stay too, as do texts without words and rows without doc_id whose group has none."""
    return shielded(docs, ("doc_id", "text"), lambda d: _drop_near_copies(d, k, percent))


def _drop_near_copies(docs: DataFrame, k: int, percent: int) -> DataFrame:
    found = near_duplicates(docs, k, percent)
    gone = saved(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    dropped(*found._credalis_reads)
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build_distributed(gone, *bloom.halves(F.xxhash64("_gone"))))
    maybe = F.arrow_udf(lambda h: pa.array(bloom.contains(np.frombuffer(bits.value, np.uint8), h.to_numpy().view(np.uint64)), pa.bool_()), "boolean")
    seen = docs.withColumn("_maybe", maybe(F.xxhash64(F.col("doc_id").cast("long"))))
    kept = seen.filter("not _maybe").drop("_maybe")
    return kept.unionByName(seen.filter("_maybe").drop("_maybe").join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all rows of ``documents``, by shingles of four words. Null, empty and blank texts have no
    shingles and stand alone; rows that repeat a doc_id are one node; extra columns are not read."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
    FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (m + n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node WHERE reach.root < edges.b)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(root) AS component_id, sets.doc_id = min(root) AS kept
FROM sets JOIN reach ON reach.node = sets.doc_id GROUP BY sets.doc_id, s
"""
