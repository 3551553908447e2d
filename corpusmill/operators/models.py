"""Model slots with defaults that need no network: an embedder, a passage scorer, a question generator.

An embedder maps texts to integer vectors; real models can return floats. The default hashes
tokens to 64 signed buckets by md5, which SQL can reproduce.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import distinct_tokens

DIMENSIONS = 64
PASSAGE_CHARS = 8000
#: Tokens whose place a worker remembers; the frequent ones come back soon after it has forgotten all.
PLACES = 1 << 16
_WORD = re.compile(r"[^\W]+")


class Embedder(Protocol):
    """Vectors of texts. A model that wants texts marked has ``passage_prefix`` and ``query_prefix``."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of tokens: bucket and sign from the first 32 bits of md5."""

    dimensions = DIMENSIONS

    def __init__(self) -> None:
        self.places: dict[str, tuple[int, int]] = {}

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in enumerate(texts):
            for token in _WORD.findall(text.lower()):
                place = self.places.get(token)
                if place is None:
                    if len(self.places) >= PLACES:
                        self.places = {}
                    h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
                    place = self.places[token] = (h % DIMENSIONS, 1 if h // DIMENSIONS % 2 == 0 else -1)
                out[row, place[0]] += place[1]
        return out


class PassageScorer(Protocol):
    """A model that scores pairs of question and passage, such as a cross-encoder."""

    def score(self, questions: list[str], passages: list[str]) -> list[float]: ...


def embed(rows: DataFrame, text: str, embedder: type[Embedder] = HashingEmbedder, vector: str = "vector", kind: str = "passage") -> DataFrame:
    """rows with a vector column; the model is loaded once in a task. kind: ``passage`` or ``query``."""
    prefix = getattr(embedder, f"{kind}_prefix", "")
    schema = T.StructType([*rows.schema.fields, T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = np.asarray(model.embed([prefix + (x or "") for x in batch.column(text).to_pylist()]), float)
                ends = pa.array(np.arange(len(found) + 1) * model.dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], schema.names)

    return rows.mapInArrow(run, schema)


def coverage(question: str | Column, passage: str | Column) -> Column:
    """Default scorer: the share of the question's distinct tokens that the passage's first characters have."""
    asked = distinct_tokens(question)
    there = distinct_tokens(F.substring(F.col(passage) if isinstance(passage, str) else passage, 1, PASSAGE_CHARS))
    return F.coalesce(F.size(F.array_intersect(asked, there)) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def batched(model: type[PassageScorer]) -> Callable[[str | Column, str | Column], Column]:
    """A scorer out of a model; it is loaded once in a worker and gets a batch of pairs at a time, passages cut as for coverage()."""
    held: list[PassageScorer] = []

    def run(questions: pd.Series, passages: pd.Series) -> pd.Series:
        if not held:
            held.append(model())
        return pd.Series(held[0].score(questions.fillna("").tolist(), passages.fillna("").tolist()), dtype=float)

    scorer = F.pandas_udf(run, "double")
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return lambda question, passage: scorer(as_col(question), F.substring(as_col(passage), 1, PASSAGE_CHARS))


def template_question(snippet: str | Column, words: int = 8) -> Column:
    """Default generator: a question that quotes the snippet's first words."""
    snippet = F.col(snippet) if isinstance(snippet, str) else snippet
    head = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(snippet, r"\s+", " ")), " "), 1, words), " ")
    return F.concat(F.lit("Which provision of the document sets out, among its other rules, the following: "), head, F.lit("?"))


def extractive_answer(question: str | Column, passage: str | Column) -> Column:
    """Default answer: the passage's first sentence."""
    passage = F.col(passage) if isinstance(passage, str) else passage
    return F.trim(F.element_at(F.split(passage, r"(?<=[.!?])\s"), 1))
