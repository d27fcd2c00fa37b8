"""Toxicity: a sentence model learnt from document labels by multiple-instance learning with noisy-or."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common

#: At most so many labelled documents are fitted (those with the smallest hashes of their keys); all are scored.
MAX_TRAIN = 12_000
#: Hashed features of a word: itself and its first 3 to 5 characters, which inflected forms share.
FEATURES = 1 << 18
PREFIXES = (3, 4, 5)
#: Features fitted: in at least MIN_DOCS training documents, with toxic ones among them MIN_Z deviations from the expected number.
MIN_DOCS, MIN_Z = 3, 4.0
ROUNDS, RATE, DECAY = 150, 0.1, 1e-5
START = -6.0
THRESHOLD = 0.3

#: Words, or what ends a sentence: a line end, or closing marks.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """Distinct features of a word in lower case, all below FEATURES."""
    parts = {word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)}
    return sorted({zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts})


class _Lookup(dict):
    """word -> value; remembers up to `limit` words. A sentence end has the value `end`."""

    def __init__(self, value, end, limit: int = 200_000):
        super().__init__()
        self.value, self.end, self.limit = value, end, limit

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        got = self[token] = self.end if token[0] in _ENDS else self.value(token)
        return got


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the sentences that hold a word."""
    out, start, worded = [], 0, False
    for m in _TOKEN.finditer(text):
        if m[0][0] in _ENDS:
            if worded:
                out.append((start, m.end()))
            start, worded = m.end(), False
        else:
            if not worded:
                start = m.start()
            worded = True
    return out + [(start, len(text))] * worded


def instances(text: str | None, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text's words and where each of its sentences begins among them.

    Every sentence with a word counts, also if no feature of its words does; a text without
    words is one sentence of none. The lookup has None for sentence ends.
    """
    flat, starts, worded = [], [], False
    for got in map(lookup.__getitem__, _TOKEN.findall((text or "").lower())):
        if got is None:
            worded = False
        else:
            if not worded:
                starts.append(len(flat))
                worded = True
            flat += got
    return np.array(flat, np.int64), np.array(starts or [0], np.int64)


class Model:
    """A document is toxic if one of its sentences is; a sentence has the logit bias + sum of word weights.

    With a leak (a logit, as fitted) a document carries it once: P = 1 - (1 - sigmoid(leak)) * exp(-risk),
    where risk is that of its worst sentence above a sentence of no weight, so length adds nothing.
    Without one every sentence carries the bias: P = 1 - prod(1 - sigmoid(logit)).
    """

    def __init__(self, bias: float, weights: np.ndarray, leak: float | None = None):
        self.bias, self.weights, self.leak = bias, weights, leak
        self._lookup = None

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "leak": self.leak, "_lookup": None}

    def sentence_logits(self, text: str | None) -> np.ndarray:
        if self._lookup is None:
            self._lookup = _Lookup(lambda w: float(self.weights[features(w)].sum()), np.inf)
        v = np.fromiter(map(self._lookup.__getitem__, _TOKEN.findall((text or "").lower())), np.float64)
        end = np.isinf(v)
        word = v[~end]
        if not len(word):
            return np.array([self.bias])
        starts = np.unique(np.concatenate([[0], np.cumsum(~end)[end]]))
        return self.bias + np.add.reduceat(word, starts[starts < len(word)])

    def score(self, text: str | None) -> float:
        """Noisy-or of the leak and the worst sentence, or of all sentences if there is no leak."""
        z = self.sentence_logits(text)
        if self.leak is None:
            return float(-np.expm1(-np.logaddexp(0, z).sum()))
        risk = max(0.0, np.logaddexp(0, z.max()) - np.logaddexp(0, self.bias))
        return float(-np.expm1(-np.logaddexp(0, self.leak) - risk))


def fit(words: list[np.ndarray], starts: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Full-batch Adam over the features that words hold; each document has at least one sentence.

    The likelihood is the noisy-or of a leak per document and of what each sentence has above
    one of no weight; sentences below that have nothing.
    """
    weights = np.zeros(FEATURES)
    if not len(words) or toxic.min() == toxic.max():
        return Model(START, weights, START if not len(words) or not toxic.max() else -START)
    y = toxic.astype(bool)
    # sentence of each word and document of each sentence, over all documents
    n_words = np.array([len(w) for w in words])
    doc_of = np.repeat(np.arange(len(words)), [len(s) for s in starts])
    first = np.concatenate([s + o for s, o in zip(starts, np.concatenate([[0], np.cumsum(n_words)[:-1]]))])
    flat = np.concatenate(words)
    # a sentence without words begins where its successor does: the last that begins at or before a word holds it
    sent_of = np.searchsorted(first, np.arange(len(flat)), side="right") - 1
    used, flat = np.unique(flat, return_inverse=True)
    w, at = np.zeros(len(used)), np.array([START, START])
    m, v, ma, va = np.zeros(len(used)), np.zeros(len(used)), np.zeros(2), np.zeros(2)
    for t in range(1, ROUNDS + 1):
        bias, leak = at
        above = np.bincount(sent_of, weights=w[flat], minlength=len(doc_of))
        z = bias + above
        risk = np.where(above > 0, np.logaddexp(0, z) - np.logaddexp(0, bias), 0.0)
        total = np.bincount(doc_of, weights=risk, minlength=len(y)) + np.logaddexp(0, leak)
        total = np.maximum(total, 1e-12)
        # d(-log P)/d total is -1 / (e^total - 1), d(-log(1 - P))/d total is 1
        g = np.where(y, -1 / np.expm1(np.minimum(total, 50)), 1.0) / len(y)
        # a sentence of no weight may gain some; one below has no slope
        gs = np.where(above >= 0, g[doc_of], 0.0)
        p, p0 = np.exp(-np.logaddexp(0, -z)), np.exp(-np.logaddexp(0, -bias))
        gw = np.bincount(flat, weights=(gs * p)[sent_of], minlength=len(used)) + DECAY * w
        ga = np.array([(gs * (p - p0)).sum(), g.sum() * np.exp(-np.logaddexp(0, -leak))])
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        ma, va = 0.9 * ma + 0.1 * ga, 0.999 * va + 0.001 * ga * ga
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        at = at - RATE * (ma / a) / (np.sqrt(va / b) + 1e-8)
    weights[used] = w
    return Model(float(at[0]), weights, float(at[1]))


def _counted(batches):
    """feature, seen, hits of one task's documents (y, text): arrays of FEATURES numbers, whatever the input's size."""
    lookup, seen, hits = _Lookup(features, None), np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.unique(instances(t.as_py(), lookup)[0])
            seen[own] += 1
            hits[own] += y
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array(hits[some])], names=["feature", "seen", "hits"])


def significant(counts: DataFrame, n: int, toxic: int) -> DataFrame:
    """Features whose number of toxic documents is MIN_Z deviations or more from what `toxic` of n lets expect."""
    rate = toxic / max(n, 1)
    sums = counts.groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).where(F.col("seen") >= MIN_DOCS)
    return sums.where(F.abs(F.col("hits") - F.col("seen") * rate) >= F.sqrt(F.col("seen") * (rate * (1 - rate))) * MIN_Z).select("feature")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", limit: int = MAX_TRAIN) -> Model:
    """Fits on labelled documents whose crc32(key as text) mod 4 is not 2.

    Null labels and null keys are left out; a key with several labels counts as toxic if one
    is. The bounded list of keys is broadcast. Features are counted on the executors; the
    driver gets the significant ones and, of each training document, where those stand.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    chosen = chosen.groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = common.written(chosen.orderBy(F.xxhash64("k"), "k").limit(limit))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k")
    n, toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = common.map_batches(rows.select("y", "text"), _counted, "feature long, seen long, hits long")
    used = frozenset(r["feature"] for r in significant(counts, n, toxic).collect())

    def make():
        lookup = _Lookup(lambda w: [f for f in features(w) if f in used], None)

        def each(cols):
            made = [instances(t, lookup) for t in cols["text"]]
            return {"k": cols["k"], "y": cols["y"], "words": [w.astype("<i4").tobytes() for w, _ in made], "starts": [s.astype("<i4").tobytes() for _, s in made]}

        return each

    out = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("words", pa.binary()), ("starts", pa.binary())])
    got = common.over_rows(rows.select("k", "y", "text"), "k long, y int, words binary, starts binary", out, make).collect()
    got.sort(key=lambda r: (r["k"], r["words"], r["starts"]))
    return fit(
        [np.frombuffer(r["words"], "<i4").astype(np.int64) for r in got],
        [np.frombuffer(r["starts"], "<i4").astype(np.int64) for r in got],
        np.array([r["y"] for r in got], np.int64),
    )


def scorer(model: Model):
    """A column function from text to score; null counts as empty. The weights (2 MB) are broadcast."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    return score


def locator(model: Model, threshold: float = THRESHOLD):
    """A column function from text to its offending sentences as array<struct<start, end, score>> (code points)."""

    @F.pandas_udf("array<struct<start:long,end:long,score:double>>")
    def locate(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            found = []
            if t and model.score(t) >= threshold:
                for s, e in sentences(t):
                    p = model.score(t[s:e])
                    if p >= threshold:
                        found.append({"start": s, "end": e, "score": p})
            out.append(found)
        return pd.Series(out)

    return locate


def op9_toxicity(spark, sf_dir):
    """Scores of all `documents` by a model of `labels`."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
