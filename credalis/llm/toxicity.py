"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over all terms of a bounded labelled sample.

Terms are lower-cased words and the byte n-grams that begin a word; none of the sample's is left out. Examples and texts
are vectors of length 1 with weights (1 + log tf) * idf * relevance. Most words of a text say nothing about its label, so the
relevance of a term grows with how surely it goes with label 1, and never falls below ``LEAST``: with plain TF-IDF (relevance
1) the examples on the same subject are nearest, whatever their label (figures in the README).

The index is an inverted one, cut into blocks of ``BLOCK`` examples that are alike. Rare terms have postings; for the common
ones each block has a small matrix, and the largest weight of each term in it bounds the cosines of the whole block. Blocks
are visited in order of their bounds until none left can change the ``k`` nearest; those near the best are summed again in
double precision, so the result is exact. Both labels are searched in the same way.

The neighbours vote by their cosines. A logistic curve fitted on the examples themselves, each searched without itself,
turns the vote into a score; a copy of an example takes that example's label. The neighbours are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm import kernel as K
from credalis.llm import near_dedup
from credalis.llm.language import held_out
from credalis.llm.store import table

#: Expected number of labelled examples of each class that are read for training; drawn by a hash of doc_id.
TRAIN_POSITIVE, TRAIN_NEGATIVE = 1200, 2400
#: Only texts of at most so many characters serve as examples.
EXAMPLE_CHARS = 20_000
PREFIXES = (3, 4, 5)
NEIGHBOURS = 15
BLOCK = 64
#: Groups of like examples that blocks are made from.
GROUPS = 24
#: Terms in more than one of so many examples are held densely.
COMMON = 16
#: Texts that are searched at once.
BATCH = 64
#: Relevance of a term that doesn't go with label 1; one that does has a tenth of its standard score more.
LEAST = 0.02
#: Added to the sum of cosines that a vote is divided by: neighbours that are far off say little.
FAR = 0.1
#: A text takes the nearest example's label by its cosine to this power: 1 for a copy, 0.5 at 0.99, 0.04 at 0.95.
COPY_POWER = 64
#: Blocks that each text visits before it asks which others it needs.
FIRST = 6
#: Single-precision sums are this close.
SLACK = 2e-5


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all terms of each row: words, and the first bytes of words longer than that."""
    starts, ends, first = K.word_spans(data, offsets, K.ALNUM)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = K.running(data)
    hashes, owners = [K.span_hashes(total, starts, ends)], [rows]
    for n in PREFIXES:
        long = ends - starts > n
        # a prefix is another term than the word it equals
        hashes.append(K.mix(K.span_hashes(total, starts[long], starts[long] + n) ^ np.uint64(n)))
        owners.append(rows[long])
    return np.concatenate(hashes), np.concatenate(owners)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of about ``K.SLICE`` bytes; a longer row is cut between words, and comes in several parts."""
    for i, j in K.slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > 2 * K.SLICE and j == i + 1:
            gaps = np.flatnonzero(~K.ALNUM[data[lo + K.SLICE : lo + 2 * K.SLICE]])
            if not len(gaps):
                break  # a word longer than that
            cut = lo + K.SLICE + int(gaps[0])
            yield i, data[lo:cut], np.array([0, cut - lo])
            lo = cut
        yield i, data[lo:hi], np.maximum(offsets[i : j + 1] - lo, 0)


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, how often) of the distinct terms of each row, part by part; a row that comes in several parts has terms in each."""
    for first, part, own in pieces(data, offsets):
        hashes, rows = term_hashes(part, own)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))))
        yield (rows[begin] + first).astype(np.int32), hashes[begin], np.diff(np.concatenate((begin, [len(rows)]))).astype(np.int32)


@dataclass
class BlockMaxIndex:
    """Vectors of labelled examples, in blocks of ``BLOCK``. ``dense[block, k]`` holds the weights of the k-th common term in a
    block and ``dense_max[k, block]`` the largest of them; the other terms have postings. ``own_*`` are the vectors by example."""

    ids: np.ndarray
    labels: np.ndarray
    common: np.ndarray  # number of each term among the common ones, or -1
    dense: np.ndarray
    dense_max: np.ndarray
    starts: np.ndarray  # of each term's postings
    examples: np.ndarray
    weights: np.ndarray
    cut: np.ndarray  # of each example's terms
    own_terms: np.ndarray
    own_weights: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> BlockMaxIndex:
        """Of sparse vectors ordered by row and term."""
        n = len(ids)
        rows, terms, weights = rows.astype(np.int32), terms.astype(np.int32), weights.astype(np.float32)
        many = np.bincount(terms, minlength=n_terms) * COMMON > n
        common = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        own = many[terms]
        full = np.zeros((n, int(many.sum())), np.float32)
        full[rows[own], common[terms[own]]] = weights[own]
        place = np.empty(n, np.int32)
        order = alike(full)
        place[order] = np.arange(n)
        rows = place[rows]
        sort = np.lexsort((terms, rows))
        rows, terms, weights = rows[sort], terms[sort], weights[sort]
        n_blocks = max(1, -(-n // BLOCK))
        dense = np.zeros((n_blocks, full.shape[1], BLOCK), np.float32)
        for block in range(n_blocks):
            some = order[block * BLOCK : (block + 1) * BLOCK]
            dense[block, :, : len(some)] = full[some].T
        del full
        rare = ~many[terms]
        sort = np.flatnonzero(rare)[np.argsort(terms[rare], kind="stable")]
        starts = np.searchsorted(terms[sort], np.arange(n_terms + 1))
        return cls(ids[order], labels[order], common, dense, np.ascontiguousarray(dense.max(2).T), starts, rows[sort].astype(np.int32), weights[sort], np.searchsorted(rows, np.arange(n + 1)), terms.astype(np.int32), weights)

    def search(self, cut: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text, whose vector is ``terms[cut[i]:cut[i + 1]]``, the ``k`` nearest examples with a cosine above 0 and their
        cosines: by cosine, then by id."""
        full = np.zeros(len(self.common))
        for lo in range(0, len(cut) - 1, BATCH):
            own = cut[lo : lo + BATCH + 1]
            score, least = self._scores(own - own[0], terms[own[0] : own[-1]], weights[own[0] : own[-1]], k)
            for i in range(len(score)):
                some = np.flatnonzero((score[i] > 0) & (score[i] >= least[i] - SLACK))
                t = terms[own[i] : own[i + 1]]
                full[t] = weights[own[i] : own[i + 1]]
                cosines = self._exact(full, some)
                full[t] = 0
                best = np.lexsort((self.ids[some], -cosines))[:k]
                yield some[best], np.minimum(cosines[best], 1.0)

    def _exact(self, full: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.array([full.take(self.own_terms[a:b]) @ self.own_weights[a:b] for a, b in zip(self.cut[some].tolist(), self.cut[some + 1].tolist(), strict=True)])

    def _scores(self, cut: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines of a batch with the examples, -1 in blocks whose bound shows that they hold none of the ``k`` nearest; the k-th largest of each text)."""
        m, n, b = len(cut) - 1, len(self.ids), len(self.dense)
        rows = np.repeat(np.arange(m), np.diff(cut))
        at = self.common[terms]
        many = at >= 0
        wide = np.zeros((m, self.dense.shape[1]), np.float32)
        wide[rows[many], at[many]] = weights[many]
        rows, terms, weights = rows[~many], terms[~many], weights[~many]
        sizes = self.starts[terms + 1] - self.starts[terms]
        some = _ranges(self.starts[terms], sizes)
        rest = np.bincount(np.repeat(rows * (b * BLOCK), sizes) + self.examples[some], np.repeat(weights, sizes) * self.weights[some], m * b * BLOCK).astype(np.float32).reshape(m, b, BLOCK)
        bound = wide @ self.dense_max + rest.max(2)
        score = np.full((m, b, BLOCK), -1, np.float32)
        seen, least, step = np.zeros((m, b), bool), np.zeros(m, np.float32), FIRST
        while True:
            left = np.where(~seen & (bound > 0) & (bound >= least[:, None] - SLACK), bound, -1)
            if not (left > 0).any():
                return score.reshape(m, -1)[:, :n], least
            # the best of each text, then all that are left
            worst = np.partition(left, b - min(step, b), 1)[:, b - min(step, b)]
            now = (left > 0) & (left >= worst[:, None])
            for block in np.flatnonzero(now.any(0)).tolist():
                own = np.flatnonzero(now[:, block])
                score[own, block] = wide[own] @ self.dense[block] + rest[own, block]
            seen |= now
            least = kth(score.reshape(m, -1), k)
            step = b


def kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 at least."""
    n = score.shape[1]
    return np.maximum(np.partition(score, n - k, 1)[:, n - k], 0) if n > k else np.zeros(len(score), score.dtype)


def alike(full: np.ndarray, rounds: int = 6) -> np.ndarray:
    """An order of the rows in which like ones are neighbours: by the nearest of ``GROUPS`` means, found from spread rows."""
    if len(full) <= BLOCK or not full.shape[1]:
        return np.arange(len(full))
    means = full[np.linspace(0, len(full) - 1, GROUPS).astype(int)]
    for _ in range(rounds):
        near = (full @ means.T).argmax(1)
        means = np.stack([full[near == g].mean(0) if (near == g).any() else means[g] for g in range(GROUPS)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return np.argsort(near, kind="stable")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@dataclass
class ToxicityModel:
    terms: np.ndarray  # sorted hashes of all terms
    weight: np.ndarray  # idf times relevance
    index: BlockMaxIndex
    slope: float
    offset: float
    base: float  # score of a text without neighbours

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, terms, weights) of the terms that the examples have, of length 1 for each row."""
        cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for rows, hashes, tf in counted(data, offsets):
            if not len(self.terms):
                continue
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            known = self.terms[at] == hashes
            cells.append(rows[known].astype(np.int64) * len(self.terms) + at[known])
            counts.append(tf[known])
        return unit(*summed(np.concatenate(cells), np.concatenate(counts)), self.weight)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The balance of labels among the neighbours, weighted by their cosines, between -1 and 1."""
        return float((cosines * (2 * self.index.labels[found] - 1)).sum() / (cosines.sum() + FAR))

    def score(self, found: np.ndarray, cosines: np.ndarray) -> float:
        if not len(found):
            return self.base
        p = float(1 / (1 + np.exp(-(self.slope * self.vote(found, cosines) + self.offset))))
        return p + float(cosines[0]) ** COPY_POWER * (float(self.index.labels[found[0]]) - p)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[float, list[dict]]]:
        rows, terms, weights = self.vectors(data, offsets)
        out = []
        for found, cosines in self.index.search(np.searchsorted(rows, np.arange(len(offsets))), terms, weights, NEIGHBOURS):
            out.append((self.score(found, cosines), [{"doc_id": d, "label": y, "cosine": c} for d, y, c in zip(self.index.ids[found].tolist(), self.index.labels[found].tolist(), cosines.tolist(), strict=True)]))
        return out


def summed(cell: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the sums of their counts."""
    order = np.argsort(cell, kind="stable")
    cell, tf = cell[order], tf[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
    return cell[begin], np.add.reduceat(tf, begin) if len(begin) else tf


def unit(cell: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, weights) of the vectors with those counts; ``cell`` is row * terms + term, in order."""
    rows, terms = cell // max(1, len(weight)), cell % max(1, len(weight))
    w = (1 + np.log(tf)) * weight[terms]
    norm = np.sqrt(np.bincount(rows, w * w)) if len(rows) else np.zeros(0)
    return rows, terms, w / norm[rows] if len(rows) else w


def relevance(pos: np.ndarray, df: np.ndarray, share: float) -> np.ndarray:
    """Of terms in ``df`` examples, ``pos`` of them with label 1, where ``share`` of all examples have it."""
    z = (pos - df * share) / np.sqrt(df * share * (1 - share) + 1)
    return LEAST + np.maximum(z, 0) / 10


def train(rows: list[tuple[int, str, int]], rate: float | None = None) -> ToxicityModel:
    """Fits on ``(doc_id, text, label)``; near copies count once. ``rate``: the share of label 1 that scores are calibrated to,
    by default that of the rows."""
    rows = families(rows)
    raw = [t.encode() for _, t, _ in rows]
    ids, y = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    parts = list(counted(data, offsets))
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in parts)]))
    cell, tf = summed(np.concatenate([np.zeros(0, np.int64), *(r.astype(np.int64) * max(1, len(terms)) + np.searchsorted(terms, h) for r, h, _ in parts)]), np.concatenate([np.zeros(0, np.int32), *(n for *_, n in parts)]))
    del parts
    r, t = (cell // max(1, len(terms))).astype(np.int32), (cell % max(1, len(terms))).astype(np.int32)
    df, share = np.bincount(t, minlength=len(terms)), float(y.mean()) if len(y) else 0.0
    weight = np.log((1 + len(y)) / np.maximum(1, df)) * relevance(np.bincount(t, y[r], len(terms)), df, share)
    r, t, w = unit(cell, tf, weight)
    model = ToxicityModel(terms, weight, BlockMaxIndex.of(ids, y, r, t, w, len(terms)), 1.0, 0.0, 0.0)
    n1 = float(y.sum())
    rate = share if rate is None else rate
    each = np.where(y > 0, rate * len(y) / max(1.0, n1), (1 - rate) * len(y) / max(1.0, len(y) - n1))
    votes = np.full(len(y), np.nan)
    # each example without itself; examples may share an id
    place = model.index
    for i, (found, cosines) in zip(np.arange(len(y)), place.search(np.searchsorted(r, np.arange(len(y) + 1)), t, w, NEIGHBOURS + 1), strict=True):
        same = np.flatnonzero((place.ids[found] == ids[i]) & (cosines > 1 - 1e-6))[:1]
        found, cosines = np.delete(found, same)[:NEIGHBOURS], np.delete(cosines, same)[:NEIGHBOURS]
        if len(found):
            votes[i] = model.vote(found, cosines)
    alone = np.isnan(votes)
    model.base = float(((each * y)[alone].sum() + rate) / (each[alone].sum() + 1)) if len(y) else 0.0
    model.slope, model.offset = logistic(votes[~alone], y[~alone], each[~alone])
    return model


def families(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """One row, that of the smallest doc_id, of those whose texts share two bands of minhashes: a group of copies is no evidence for its words."""
    out, seen = [], set()
    for row in sorted(rows):
        raw = np.frombuffer(row[1].encode(), np.uint8)
        words = K.shingle_sets(raw, np.array([0, len(raw)]), 3)
        bands = near_dedup.band_values(words)[0].tolist() if len(words[0]) else []
        known = [(i, b) in seen for i, b in enumerate(bands)]
        seen.update(enumerate(bands))
        if sum(known) < 2:
            out.append(row)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton's method with a little shrinkage."""
    if not len(x):
        return 1.0, 0.0
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + ridge * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 0.0)), float(b)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.02) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton's method with a little shrinkage."""
    if not len(x):
        return 1.0, 0.0
    each = np.ones(len(x)) if weight is None else weight
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = each * (p * (1 - p) + 1e-9)
        g = np.array([(each * (p - target) * x).sum() + ridge * a, (each * (p - target)).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(max(a, 0.0)), float(b)


def sample(docs: DataFrame, labels: DataFrame, eligible: Column, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> tuple[list[tuple[int, str, int]], float]:
    """(the labelled examples, about so many of each class; the share of label 1 among all). A document with labels that disagree is left out."""
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & eligible).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).filter("y = z").select("doc_id", "y")
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = own.filter(draw < F.when(F.col("y") == 1, positive / max(1, counts.get(1, 0))).otherwise(negative / max(1, counts.get(0, 0))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= EXAMPLE_CHARS)
    # a bounded number of rows: the sample's size doesn't grow with the table
    found = texts.join(F.broadcast(chosen.limit(4 * (positive + negative))), "doc_id").select("doc_id", "text", "y").orderBy("doc_id", "text").limit(4 * (positive + negative))
    return [(r.doc_id, r.text, int(r.y)) for r in found.collect()], counts.get(1, 0) / max(1, sum(counts.values()))


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None = None) -> ToxicityModel:
    return train(*sample(docs, labels, F.lit(True) if eligible is None else eligible))


EVIDENCE = "array<struct<doc_id: bigint, label: bigint, cosine: double>>"


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``evidence`` (the nearest examples, their labels and cosines) added; columns of these
    names are replaced, others are carried and not read.

    Only the text is read, whole and however long. Null, empty and unknown texts have no neighbours; their score is the
    share of label 1 among examples without neighbours. Ties between neighbours go to the smaller doc_id. Each row stands
    for itself, so repeated rows repeat their result; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64()), ("cosine", pa.float64())]))

    def scan(texts: pa.Array) -> pa.Array:
        data, offsets = K.text_buffers(texts)
        got: list[tuple[float, list[dict]]] = []
        for i, j in K.slices(offsets):
            got += shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return pa.StructArray.from_arrays([pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], arrow)], ["score", "evidence"])

    got = F.arrow_udf(scan, f"score double, evidence {EVIDENCE}")(docs[text].cast("string"))
    return docs.withColumns({c: got[c] for c in ("score", "evidence")})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from the labels whose crc32(doc_id) mod 3 is not 1. Null and empty
    texts get the score of texts without neighbours. A null doc_id is not held out; repeated rows each give their row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
