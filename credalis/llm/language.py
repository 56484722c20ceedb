"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords: byte n-grams within words (ASCII other than letters is one
boundary byte). Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample. Since
the softmax is linear in the average, prediction gathers the product of the two, one row per subword bucket (with many
languages the embeddings, and multiplies once a text).

Calibration: a temperature fitted on texts kept from training turns scores into probabilities, and texts below a
threshold set on the same texts are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm import kernel as K
from credalis.llm.store import table

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
WIDTH = 16
#: Bytes that prediction works through at once.
WINDOW = 1 << 16
#: Expected number of training texts of each language, and of all; the sample is drawn by a hash of doc_id.
TRAIN_DOCS, TRAIN_ALL = 400, 100_000
#: Texts of more characters serve for training only where a language has no shorter ones, and then at most LONG_DOCS of it.
TRAIN_CHARS, LONG_DOCS = 20_000, 4
#: Of texts of the learned languages, at most this share should be rejected.
REJECT_RATE = 0.002

_SYMBOL = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in K.LOWER.tolist()], np.uint32)


def subword_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (the last ``size - 1`` bytes start none)."""
    s = _SYMBOL[data]
    n = len(s) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, size, np.uint32)
    for j in range(size):
        h = (h ^ s[j : j + n]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subword buckets of a text and their shares."""
    data = np.frombuffer(f" {text} ".encode(), np.uint8)
    buckets, counts = np.unique(np.concatenate([subword_buckets(data, n) for n in SIZES]), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    """``table``: the embedding of each bucket, times the softmax weights already where that is not wider (``weights`` is None then).
    ``threshold``: calibrated scores below it are rejected."""

    langs: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    @classmethod
    def of(cls, langs: list[str], emb: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> LanguageModel:
        if len(langs) <= WIDTH:
            return cls(langs, np.ascontiguousarray(emb @ weights), None, bias)
        return cls(langs, emb, weights, bias)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of whole texts; each is read with a boundary before and after it. Works through ``WINDOW`` bytes at once, so
        its arrays don't grow with a text."""
        raw, cuts = data.tobytes(), offsets.tolist()
        padded = np.frombuffer(b" " + b"  ".join([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) + b" ", np.uint8)
        begin = offsets[:-1] + 2 * np.arange(len(offsets) - 1)
        lengths = np.diff(offsets) + 2
        total = np.zeros((len(lengths), self.table.shape[1]))
        for lo in range(0, len(padded), WINDOW):
            for n in SIZES:
                b = subword_buckets(padded[lo : lo + WINDOW + n - 1], n)
                if not len(b):
                    continue
                ends = begin + np.maximum(lengths - n + 1, 0)
                rows = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(begin, lo + len(b), "left"))
                first, last = np.maximum(begin[rows], lo) - lo, np.minimum(ends[rows], lo + len(b)) - lo
                full = first < last
                spans = np.stack((first[full], last[full]), 1).ravel()
                got = np.concatenate((self.table[b], np.zeros((1, total.shape[1]), np.float32)))
                total[rows[full]] += np.add.reduceat(got, spans, axis=0)[::2] if len(spans) else 0
        count = sum(np.maximum(lengths - n + 1, 0) for n in SIZES)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.2, seed: int = 11) -> LanguageModel:
    """Fits on ``(text, lang)`` rows; one row in five only calibrates."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    if not langs:
        return LanguageModel.of([], emb, w, bias)
    data = [(*features(text), langs.index(lang), text) for text, lang in rows]
    order = rng.permutation(len(data))
    held = [data[i] for i in order[: len(data) // 5]] if len(data) >= 25 else data
    fit = [data[i] for i in order[len(data) // 5 :]] if len(data) >= 25 else data
    steps, at = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            buckets, share, y, _ = fit[i]
            step = rate * (1 - at / steps)
            hidden = share @ emb[buckets]
            err = _softmax(hidden @ w + bias)
            err[y] -= 1
            back = w @ err
            w -= step * np.outer(hidden, err)
            bias -= 0.1 * step * err
            emb[buckets] -= step * len(buckets) ** 0.5 * np.outer(share, back)
            at += 1
    model = LanguageModel.of(langs, emb, w, bias)
    raw = [t.encode() for *_, t in held]
    logits = model.logits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    y = np.array([h[2] for h in held])

    # as many texts without an error don't show that there is none: the targets leave a share for one more text
    slack = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        model.temperature = t
        p = np.log(np.maximum(model.probabilities(logits), 1e-12))
        own = p[np.arange(len(y)), y]
        return float(-((1 - slack) * own + slack * (p.sum(1) - own) / max(1, len(langs) - 1)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.1, 50, 80)), key=loss)
    best = model.probabilities(logits).max(1)
    # a text that is below this, or as likely of another language as of its own, is of none of them
    model.threshold = float(min(0.5, np.quantile(best, REJECT_RATE)))
    return model


def sample(docs: DataFrame, eligible: Column, n: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """About ``n`` texts of each language (fewer of each beyond ``TRAIN_ALL / n`` languages), picked by a hash of doc_id; of a language with fewer, all."""
    usable = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    usable = usable.withColumn("long", F.length("text") > TRAIN_CHARS)
    counts = usable.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count(F.lit(1)).alias("all")).collect()
    if not counts:
        return []
    each = max(1, min(n, TRAIN_ALL // len(counts)))
    shares = [(r.lang, r.short == 0, min(1.0, each / r.short if r.short else LONG_DOCS / r.all)) for r in counts]
    # a row for each language
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, long boolean, share double"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    return [(r.text, r.lang) for r in usable.join(shares, ["lang", "long"]).filter(draw < F.col("share")).select("doc_id", "text", "lang").orderBy("doc_id", "lang", "text").collect()]


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(docs: DataFrame, eligible: Column | None = None, n: int = TRAIN_DOCS) -> LanguageModel:
    """Learns the values of ``docs.lang`` from the rows that ``eligible`` allows (all by default)."""
    return train(sample(docs, F.lit(True) if eligible is None else eligible, n))


def found(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """``(lang_pred, score, accepted)`` of each text as one column. Texts go to Python and only these values come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        m = shared.value
        data, offsets = K.text_buffers(texts)
        good = lettered.to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
        langs, scores = [UNKNOWN] * len(good), np.zeros(len(good))
        for i, j in K.slices(offsets):
            if good[i:j].any():
                p = m.probabilities(m.logits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                best = p.argmax(1)
                langs[i:j] = [m.langs[k] if g else UNKNOWN for k, g in zip(best.tolist(), good[i:j].tolist(), strict=True)]
                scores[i:j] = np.where(good[i:j], p[np.arange(j - i), best], 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(good & (scores >= m.threshold))], ["lang_pred", "score", "accepted"])

    body = docs[text].cast("string")
    return F.arrow_udf(scan, "lang_pred string, score double, accepted boolean")(body, F.coalesce(body.rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (calibrated probability of that language) and ``accepted`` added; columns of these
    names are replaced, others are carried and not read.

    Only the text is read, whole and however long. A text that is null, empty or without any letter, or a model that
    learned no language, gives ``und``, 0 and false. Ties go to the language that sorts first; repeated rows repeat their
    result; an empty table gives an empty one.
    """
    got = found(docs, model, text)
    return docs.withColumns({c: got[c] for c in ("lang_pred", "score", "accepted")})


def drop_unknown(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with its own columns, whatever their names, without the documents whose language is rejected: those that are
    null, empty or without letters, and those with a score below the model's threshold. All other rows stay, repeated ones too."""
    return docs.filter(found(docs, model, text)["accepted"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the labelled rows whose crc32(doc_id) mod 5 is not 0. Null and
    letterless texts: ``und``, score 0. A null doc_id is not held out. Repeated rows each give their row; extra columns are not read."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
