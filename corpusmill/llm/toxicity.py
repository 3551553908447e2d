"""Toxicity by cumulative-link ordinal regression over sparse text features.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: one weight vector for all of
the ordered thresholds. The result is the expected severity, the sum of
``P(grade > k)``, and ``p_toxic = P(grade > 0)``.

Features are words (A-Z lower-cased; letters, digits and bytes from 128) and
their prefixes of 3 to 10 bytes, valued ``1 + log(times)``. Their document
counts among labelled rows are gathered by a shuffle; the ``FEATURES`` with the
largest chi-square among those more frequent in toxic rows are kept.

Where labels have a column ``severity`` (0 to ``GRADES`` - 1), it gives the grades. Labels that say only toxic or not
have two grades and no more; toxic rows then stand for grades 1 to 3 by terciles of the number of
kept features' occurrences, so severity grows with how much of a text is toxic, but its steps above 0 are
a convention of this module and nothing that labels confirm.

The fit reads about ``TRAIN`` labelled rows, taken by a hash of doc_id (and of the text, where a doc_id
has many rows); the bound is what keeps it the same at any corpus size, as do the bounds on features, which are chosen
by counts over all those rows. All documents are scored, over
their whole texts, very long ones too. A null or empty text has no features, an empty table gives no rows. Null labels or ids
teach nothing; several labels of a doc_id count as toxic if one is, with the largest severity. Repeated rows are scored each,
and of columns only those named here are read. Without toxic or without clean labels, every severity is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORDS, pieces, raw, texts

TRAIN = 40_000
FEATURES = 4096
GRADES = 4
PREFIXES = range(3, 11)
#: A kept feature's least number of toxic rows, and its least ratio of rates.
LEAST_ROWS, LEAST_RATIO = 5, 8.0
RIDGE = 2e-5
HELD = 300_000


def word_features(word: bytes) -> list[bytes]:
    """The word, and its prefixes marked by a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if n <= len(word))]


def gather(train: DataFrame) -> DataFrame:
    """(feature, clean, toxic): numbers of rows that have the feature. train: doc_id, text, toxic, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "clean", "toxic"])

        for batch in pieces(batches):
            for text, toxic in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                counts[toxic].update({f for w in set(text.translate(WORDS).split()) for f in word_features(w)})
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield rows()
        if counts[0] or counts[1]:
            yield rows()

    return train.mapInArrow(run, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def select(counts: DataFrame, clean: int, toxic: int, features: int = FEATURES) -> list[bytes]:
    """The features most associated with toxic rows."""
    rate = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    n = F.col("toxic") + F.col("clean")
    expected = n * (toxic / (toxic + clean))
    chi = F.pow(F.col("toxic") - expected, 2) / expected
    kept = counts.where((F.col("toxic") >= LEAST_ROWS) & (rate >= LEAST_RATIO)).orderBy(chi.desc(), "feature").limit(features)
    return [bytes(r.feature) for r in kept.select("feature").collect()]


class Vectorizer:
    """Sparse feature counts of texts; words are looked up once in a while."""

    def __init__(self, features: list[bytes]) -> None:
        self.ids = {f: i for i, f in enumerate(features)}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes) -> tuple[list[int], list[int]]:
        """(feature ids, times)."""
        if len(self.words) > HELD:
            self.words = {}
        times: dict[int, int] = {}
        known, ids = self.words, self.ids
        for word in text.translate(WORDS).split():
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(ids[f] for f in word_features(word) if f in ids)
            for i in found:
                times[i] = times.get(i, 0) + 1
        return list(times), list(times.values())


class Ordinal:
    """Shared weights and ordered thresholds, fitted by Adam on the mean log-loss plus a ridge."""

    def __init__(self, size: int, grades: int = GRADES) -> None:
        self.weights = np.zeros(size)
        self.thresholds = np.linspace(1, 3, grades - 1)

    @staticmethod
    def parts(params: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds as the first one and the logs of the steps, so that they stay in order."""
        w, t = params[:size], params[size:]
        return w, np.cumsum(np.r_[t[0], np.exp(t[1:])])

    def fit(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, steps: int = 600, rate: float = 0.05) -> Ordinal:
        size, n = len(self.weights), len(grades)
        params = np.r_[self.weights, self.thresholds[0], np.log(np.diff(self.thresholds))]
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            w, cut = self.parts(params, size)
            score = np.bincount(row, value * w[column], n)
            bounds = np.r_[-np.inf, cut, np.inf]
            upper, lower = _sigmoid(bounds[grades + 1] - score), _sigmoid(bounds[grades] - score)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            gw = np.bincount(column, value * (du - dl)[row], size) / n + RIDGE * w
            gcut = np.zeros(len(cut))
            np.add.at(gcut, grades[grades < len(cut)], -du[grades < len(cut)])
            np.add.at(gcut, grades[grades > 0] - 1, dl[grades > 0])
            gcut /= n
            below = np.cumsum(gcut[::-1])[::-1]
            g = np.r_[gw, below[0], below[1:] * np.exp(params[size + 1 :])]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.thresholds = self.parts(params, size)
        return self

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> tuple[list[bytes], Ordinal] | None:
    """(features, model); None where labels don't show both kinds."""
    graded = F.col("severity").cast("int") if "severity" in labels.columns else F.lit(None).cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), graded.alias("grade"))
    known = known.where("doc_id is not null and (toxic is not null or grade is not null)")
    known = known.groupBy("doc_id").agg(F.max((F.coalesce(F.col("toxic") > 0, F.lit(False)) | F.coalesce(F.col("grade") > 0, F.lit(False))).cast("int")).alias("toxic"), F.max("grade").alias("grade"))
    share = min(1.0, train / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    known = F.broadcast(known)  # about ``train`` rows of labels
    found = texts(docs).select("doc_id").join(known, "doc_id").count()
    sample = texts(docs).join(known, "doc_id").select("doc_id", "text", "toxic", "grade")
    if found > 2 * train:  # ids with very many rows
        sample = sample.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(train / found * 1_000_003))
    features = select(gather(sample), sizes[0], sizes[1])
    if not features:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectorizer(features)
        for batch in pieces(batches):
            found = [vector(x) for x in raw(batch.column(1))]
            columns = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), *columns], ["toxic", "grade", "ids", "times"])

    rows = sample.mapInArrow(run, "toxic int, grade int, ids array<int>, times array<int>").toArrow().to_pylist()
    toxic = np.array([r["toxic"] for r in rows])
    total = np.array([sum(r["times"]) for r in rows])
    cuts = np.quantile(total[toxic == 1], [(k + 1) / (GRADES - 1) for k in range(GRADES - 2)]) if toxic.any() else []
    grades = np.where(toxic == 1, 1 + sum((total > c).astype(int) for c in cuts), 0)
    own = np.array([-1 if r["grade"] is None else r["grade"] for r in rows])
    grades = np.where(own >= 0, np.minimum(own, GRADES - 1), grades)
    row = np.repeat(np.arange(len(rows)), [len(r["ids"]) for r in rows])
    column = np.array([i for r in rows for i in r["ids"]], np.int64)
    value = 1 + np.log(np.array([t for r in rows for t in r["times"]], float))
    return features, Ordinal(len(features)).fit(row, column, value, grades)


def score(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> DataFrame:
    """doc_id, severity (0 to GRADES - 1), p_toxic, toxic (p_toxic of a half or more), n_features: a row for each of docs."""
    model = fit(docs, labels, train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectorizer(model[0] if model else [])
        for batch in pieces(batches):
            rows = []
            for text in raw(batch.column(1)):
                ids, times = vector(text)
                above = model[1].above(sum(model[1].weights[i] * (1 + math.log(t)) for i, t in zip(ids, times, strict=True))) if model else [0.0]
                rows.append((float(sum(above)), float(above[0]), above[0] >= 0.5, sum(times)))
            kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "severity", "p_toxic", "toxic", "n_features"])

    return texts(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean, n_features long")
