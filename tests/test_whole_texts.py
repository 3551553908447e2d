"""Queries without SQL over whole texts, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import queries


def distance(x, y):
    steps = np.arange(len(y) + 1)
    row, letters = steps, np.array(list(y))
    for i, c in enumerate(x, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (letters != c))]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def near(x, y):
    x, y = (re.sub(r"\s+", " ", t.lower()).strip(" ") for t in (x, y))
    n = max(len(x), len(y))
    return not n or 1 - distance(x, y) / n >= 0.5


def test_edit_similarity(spark, sf):
    contexts, references = (x.collect() for x in queries._contexts(spark, sf, F.col))
    gold = {r.query_id: r.reference_text for r in references}
    assert max(len(r.text) for r in contexts) > 120 and max(map(len, gold.values())) > 120
    hits = {}
    for r in sorted(contexts, key=lambda r: r["rank"]):
        hits.setdefault(r.query_id, []).append(near(r.text, gold[r.query_id]))
    precision = {q: sum(h * sum(x[: i + 1]) / (i + 1) for i, h in enumerate(x)) / (sum(x) + 1e-10) for q, x in hits.items()}
    got = {r.query_id: r.context_precision for r in queries.QUERIES["edit_similarity_precision_whole"](spark, sf).collect()}
    assert got == pytest.approx(precision, abs=1e-6)
    got = {r.query_id: r.context_recall for r in queries.QUERIES["edit_similarity_recall_whole"](spark, sf).collect()}
    assert got == {q: float(any(hits.get(q, []))) for q in gold}


def test_stream_tokens(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = sorted((r.conv_id, r.turn, re.sub("[^A-Za-z ]", "", r.text) + "!" * (r.turn % 3 == 0)) for r in turns)
    assert sorted(map(tuple, queries.QUERIES["stream_tokens"](spark, sf).collect())) == want
