"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters'
vectors, permuted by their place: ``rotate(a, 2) * rotate(b, 1) * c``. A text
bundles (sums) the vectors of its trigrams over letters, where any run of
other characters is one blank; a language bundles its training texts, each
scaled to length one. The prediction is the language of the largest cosine.

Training reads at most ``PER_LANGUAGE`` labelled texts of each language, taken
by a hash of doc_id; the bound keeps the fit the same at any corpus size. What is
gathered is one vector of a language and partition. The number of distinct
labels must be small, since prototypes are broadcast.

A null or empty text, or one without a letter, is ``und`` with score 0. With
nothing to learn from, every text is. A language whose texts have no trigram isn't learned. Ties go to the alphabetically first
language. A null doc_id counts as the empty text for held_out. Very long texts are read whole, repeated rows are predicted each,
an empty table gives no rows, and columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import crc_column, pieces, strings, texts

DIMENSIONS = 1024
PER_LANGUAGE = 5000
UNDETERMINED = "und"
#: Letters up to here have a vector of their own, others one of 256.
OWN = 0x250
LETTERS = OWN + 256


@cache
def letter_ids() -> np.ndarray:
    """Id of every code point; 0 for those that aren't letters."""
    ids = np.zeros(0x110000, np.uint16)
    points = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    ids[points] = np.where(points < OWN, points, OWN + points % 256)
    return ids


@cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    a, b, c = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def bundles(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the texts, whether each has a letter)."""
    joined = "\n".join(x.lower() for x in bodies) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(x.lower()) + 1 for x in bodies])
    doc = np.repeat(np.arange(len(bodies)), sizes)
    ids = letter_ids()[points]
    keep = (ids != 0) | np.r_[False, ids[:-1] != 0]
    lettered = np.bincount(doc[ids != 0], minlength=len(bodies)) > 0
    ids, doc = ids[keep].astype(np.int64), doc[keep]
    out = np.zeros((len(bodies), DIMENSIONS), np.float32)
    if len(ids) < 3:
        return out, lettered
    codes = (ids[:-2] * LETTERS + ids[1:-1]) * LETTERS + ids[2:]
    same = doc[:-2] == doc[2:]
    pairs, times = np.unique(doc[:-2][same] * LETTERS**3 + codes[same], return_counts=True)
    grams, at = np.unique(pairs % LETTERS**3, return_inverse=True)
    for start in range(0, len(grams), 4096):
        use = (at >= start) & (at < start + 4096)
        counts = np.zeros((len(bodies), min(4096, len(grams) - start)), np.float32)
        counts[pairs[use] // LETTERS**3, at[use] - start] = times[use]
        out += counts @ trigram_vectors(grams[start : start + 4096]).astype(np.float32)
    return out, lettered


def scaled(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at once; fewer where they are long."""
    for batch in pieces(batches, 128):
        at, size = 0, 0
        for i, n in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            size += len(n or b"")
            if size > 1 << 21:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, scaled prototypes) from doc_id, text, lang."""
    labelled = labelled.where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in _groups(batches):
            vectors, langs = scaled(bundles(strings(batch.column(1)))[0]), np.array(batch.column(2).to_pylist())
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(data)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "total"])

    sample = labelled.where(part < shares[F.col("lang")]).select("doc_id", "text", "lang")
    schema = "lang string, total binary"
    rows = sample.mapInArrow(sums, schema).repartition(8).mapInArrow(merge, schema).collect()
    langs = sorted({r.lang for r in rows})
    totals = np.stack([sum(np.frombuffer(r.total) for r in rows if r.lang == lang) for lang in langs])
    learned = np.flatnonzero(totals.any(axis=1))
    return [langs[i] for i in learned], scaled(totals[learned]).astype(np.float32)


def training_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows to learn from: those that aren't held out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(crc_column() % 4 != 2)


def annotate(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs (doc_id, text first) with lang_pred and score behind its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNDETERMINED], object)
        for batch in _groups(batches):
            vectors, lettered = bundles(strings(batch.column(1)))
            best, score = np.full(len(vectors), len(langs)), np.zeros(len(vectors))
            if langs:
                cosines = scaled(vectors) @ shared.value.T
                best = np.where(lettered, cosines.argmax(axis=1), best)
                score = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), score).astype(float)
            columns = [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from the rows of docs that aren't held out, predict all."""
    found = annotate(texts(docs), *fit(training_rows(docs), per_language))
    return found.select("doc_id", (crc_column() % 4 == 2).alias("held_out"), "lang_pred", "score")
