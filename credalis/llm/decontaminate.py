"""Benchmark decontamination: a broadcast hash set of normalised n-grams scanned over whole texts.

The words of a benchmark block are one byte buffer; its n-grams are a sorted array of 64-bit hashes with the place of each
in the buffer, about five bytes for each byte of text, which every task receives. A task hashes all word windows of its
texts with array operations, looks them up, and compares the words of each hit with the buffer before it counts. A
benchmark larger than one block is scanned block by block, and a block goes before the next one comes, so what the driver
and the tasks hold has a fixed bound; the hits of the blocks are then combined per row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm import kernel as K
from credalis.llm.store import saved, shielded, table

WINDOW = 10
#: Bytes of benchmark text in one block: about 40 MB are broadcast, and 200 MB needed while it is built.
BLOCK_BYTES = 8 << 20

Items = list[tuple[object, str | None]]


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: A-Z lower-cased, runs of ASCII letters, digits and characters beyond ASCII."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]), K.ALNUM)
    low = K.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class GramSet:
    """The windows of a block of items. ``words`` holds all words, one space between; ``starts`` and ``ends`` tell them apart.
    For each window length: sorted hashes, and the first word and the item of each window."""

    def __init__(self, items: Items, window: int = WINDOW):
        self.ids = [i for i, _ in items]
        low = [b" ".join(normal_words(t)) for _, t in items]
        self.words = b" ".join(low)
        sizes = np.array([len(x) for x in low], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        data = np.frombuffer(self.words, np.uint8)
        starts, ends, _ = K.word_spans(data, np.array([0, len(data)]), K.NON_SPACE)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        hashes, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + K.SLICE)))
            a, b = starts[i], ends[j - 1]
            hashes[i:j] = K.word_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a)
            i = j
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, begin + sizes)
        count = last - first
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, c) for c in count.tolist()} - {0}):
            own = np.flatnonzero(np.minimum(count, window) == n)
            each = count[own] - n + 1
            item = np.repeat(own, each).astype(np.int32)
            at = np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[own], each)
            grams = K.gram_hashes(hashes, n)[at]
            order = np.lexsort((item, grams))
            self.by_length[n] = (grams[order], at[order].astype(np.int32), item[order])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, object]]]:
        """(words of each row, verified hits as (row, first word in row, window length, item))."""
        starts, ends, first = K.word_spans(data, offsets, K.ALNUM)
        words = K.word_hashes(data, starts, ends)
        out = []
        for n, (hashes, at, item) in self.by_length.items():
            grams = K.gram_hashes(words, n)
            if not len(grams):
                continue
            lo = np.searchsorted(hashes, grams)
            for w in np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == grams).tolist():
                row = int(np.searchsorted(first, w, "right")) - 1
                if w + n > first[row + 1]:
                    continue
                text = b" ".join([K.LOWER[data[a:b]].tobytes() for a, b in zip(starts[w : w + n].tolist(), ends[w : w + n].tolist(), strict=True)])
                found = set()
                for k in range(int(lo[w]), int(np.searchsorted(hashes, grams[w], "right"))):
                    if item[k] not in found and self.words[self.starts[at[k]] : self.ends[at[k] + n - 1]] == text:
                        found.add(item[k])
                out += [(row, w - int(first[row]), n, self.ids[i]) for i in found]
        return np.diff(first), out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Byte ranges of each row that hits cover, merged."""
        starts, ends, first = K.word_spans(data, offsets, K.ALNUM)
        cover: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row, w, n in {(r, w, n) for r, w, n, _ in self.hits(data, offsets)[1]}:
            cover[row].append((int(starts[first[row] + w] - offsets[row]), int(ends[first[row] + w + n - 1] - offsets[row])))
        return {row: merged(ranges) for row, ranges in cover.items()}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[Items]:
    """The items in blocks of at most ``block_bytes`` of text, brought to the driver one partition at a time. A longer item is
    cut into parts that share ``window - 1`` words, which have the same windows together."""
    block: Items = []
    size = 0
    for r in bench.select("item_id", F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        parts = [r.text]
        if len(r.text or "") > block_bytes // 4 and len((r.text or "").encode()) > block_bytes:
            words = normal_words(r.text)
            step = max(1, block_bytes * len(words) // (2 * len(r.text.encode())))
            parts = [b" ".join(words[k : k + step + window - 1]).decode() for k in range(0, max(1, len(words) - window + 1), step)]
        for text in parts:
            n = len((text or "").encode())
            if block and size + n > block_bytes:
                yield block
                block, size = [], 0
            block.append((r.item_id, text))
            size += n
    yield block


def _sliced(grams: GramSet, texts: pa.Array, f: Callable[[int, int, np.ndarray, np.ndarray], None]) -> None:
    data, offsets = K.text_buffers(texts)
    for i, j in K.slices(offsets):
        f(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _hit_words(hits: list[tuple[int, int, int, object]], n: int) -> tuple[list[set[int]], list[set[object]]]:
    words: list[set[int]] = [set() for _ in range(n)]
    items: list[set[object]] = [set() for _ in range(n)]
    for row, w, size, item in hits:
        words[row].update(range(w, w + size))
        items[row].add(item)
    return words, items


def _items_sha(items: set[object]) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in items})).encode()).hexdigest()


def _by_blocks(docs: DataFrame, first: Items, more: Iterator[Items], window: int, scan: Callable[[GramSet, pa.Array], pa.Array], out: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """(``docs(_row, _text, ...)`` written once, what ``scan`` finds in each block of the benchmark as ``(_row, hit.*)``). One block
    is in memory at a time; its finds are written before the next one comes."""
    spark = docs.sparkSession
    docs = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    frames = []
    for block in (b for part in ([first], more) for b in part):
        grams = spark.sparkContext.broadcast(GramSet(block, window))
        hit = F.arrow_udf(lambda texts, grams=grams: scan(grams.value, texts), out)(docs["_text"].cast("string"))
        frames.append(saved(docs.select("_row", hit.alias("hit")).filter(keep).select("_row", "hit.*"), "hits"))
        grams.destroy()
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return docs, found


CONTAMINATION = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs(doc_id, text)``.

    Null or empty text has no words and no hits. Items without words have no window; an item of fewer words than
    ``window`` is one window. Items may repeat: each item id counts once. Repeated documents each give their row. An
    empty benchmark leaves every count at zero. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    parts = blocks(bench, block_bytes, window)
    first, second = next(parts), next(parts, None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    if second is None:
        grams = spark.sparkContext.broadcast(GramSet(first, window))

        def scan(texts: pa.Array) -> pa.Array:
            out: tuple[list, ...] = ([], [], [], [])

            def one(i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> None:
                n_words, hits = grams.value.hits(data, offsets)
                words, items = _hit_words(hits, j - i)
                for column, values in zip(out, (n_words.tolist(), [len(w) for w in words], [len(x) for x in items], [_items_sha(x) for x in items]), strict=True):
                    column += values

            _sliced(grams.value, texts, one)
            return pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array([n > 0 for n in out[1]], pa.bool_())], [f.split()[0] for f in CONTAMINATION.split(", ")])

        return docs.select("doc_id", F.arrow_udf(scan, CONTAMINATION)(docs["_text"].cast("string")).alias("hit")).select("doc_id", "hit.*")

    def find(grams: GramSet, texts: pa.Array) -> pa.Array:
        out: tuple[list, list] = ([], [])

        def one(i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> None:
            words, items = _hit_words(grams.hits(data, offsets)[1], j - i)
            out[0].extend(sorted(w) for w in words)
            out[1].extend(sorted(map(str, x)) for x in items)

        _sliced(grams, texts, one)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.string()))], ["words", "items"])

    docs, found = _by_blocks(docs, first, (b for part in ([second], parts) for b in part), window, find, "words array<long>, items array<string>", "size(hit.words) > 0")
    both = found.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    empty = GramSet([], window)

    def count(texts: pa.Array) -> pa.Array:
        out: list[int] = []
        _sliced(empty, texts, lambda i, j, data, offsets: out.extend(empty.hits(data, offsets)[0].tolist()))
        return pa.array(out, pa.int64())

    every = docs.select("_row", "doc_id", F.arrow_udf(count, "long")(docs["_text"].cast("string")).alias("n_words")).join(both, "_row", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return every.select("doc_id", "n_words", n("w").alias("n_hit"), n("i").alias("n_items"), F.sha2(F.coalesce(F.array_join("i", ","), F.lit("")), 256).alias("items_sha256"), F.col("w").isNotNull().alias("contaminated"))


def _cut(texts: list[str | None], cover: list[list[tuple[int, int]]]) -> list[str | None]:
    """The texts without those byte ranges; each leaves one space."""
    out = []
    for text, ranges in zip(texts, cover, strict=True):
        if ranges:
            raw, pieces, end = (text or "").encode(), [], 0
            for a, z in ranges:
                pieces.append(raw[end:a])
                end = z
            text = b" ".join([*pieces, raw[end:]]).decode()
        out.append(text)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with its own columns, whatever their names: without the documents that hold a window of a benchmark item, or with
    just those spans cut out (``remove="spans"``; each leaves one space).

    Rows without hits come back unchanged, among them null and empty texts and repeated rows. An empty benchmark or one
    without words removes nothing; an empty table gives an empty one. Only the text goes to Python.
    """
    return shielded(docs, (text,), lambda d: _decontaminate(d, bench, remove, window, text, block_bytes))


def _cover(grams: GramSet, texts: pa.Array) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []

    def one(i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> None:
        cover = grams.spans(data, offsets)
        out.extend(cover.get(k, []) for k in range(j - i))

    _sliced(grams, texts, one)
    return out


def _decontaminate(docs: DataFrame, bench: DataFrame, remove: str, window: int, text: str, block_bytes: int) -> DataFrame:
    parts = blocks(bench, block_bytes, window)
    first, second = next(parts), next(parts, None)
    names = docs.columns
    if second is None:
        grams = docs.sparkSession.sparkContext.broadcast(GramSet(first, window))
        if remove == "documents":
            return docs.filter(F.arrow_udf(lambda texts: pa.array([not c for c in _cover(grams.value, texts)], pa.bool_()), "boolean")(docs[text].cast("string")))
        cut: Column = F.arrow_udf(lambda texts: pa.array(_cut(texts.to_pylist(), _cover(grams.value, texts)), pa.string()), "string")(docs[text].cast("string"))
        return docs.select(*[cut.alias(c) if c == text else docs[c] for c in names])

    def find(grams: GramSet, texts: pa.Array) -> pa.Array:
        return pa.array([{"ranges": [{"a": a, "z": z} for a, z in c]} for c in _cover(grams, texts)], pa.struct([("ranges", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))]))

    rows, found = _by_blocks(docs.withColumn("_text", docs[text]), first, (b for part in ([second], parts) for b in part), window, find, "ranges array<struct<a: long, z: long>>", "size(hit.ranges) > 0")
    if remove == "documents":
        return rows.join(found.select("_row").distinct(), "_row", "left_anti").select(*names)
    every = rows.join(found.groupBy("_row").agg(F.flatten(F.collect_list("ranges")).alias("_ranges")), "_row", "left")

    def apply(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array(_cut(texts.to_pylist(), [merged([(x["a"], x["z"]) for x in r or []]) for r in ranges.to_pylist()]), pa.string())

    return every.withColumn(text, F.arrow_udf(apply, "string")(every["_text"].cast("string"), every["_ranges"])).select(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ``benchmark`` in every whole text of ``documents``. Null and empty texts have no words; items without words no
    windows. Repeated rows each give their row; empty tables give an empty result or zero counts; extra columns are not read."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos),
hits AS (SELECT r, i, grams.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
