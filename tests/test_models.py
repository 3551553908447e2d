"""Model slots, JSON repair and small column functions."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators import enrich, rerank
from corpusmill.operators.models import batched, embed
from corpusmill.plans import chat


def models():
    """Made in a function, so that workers get them by value."""

    class Lengths:
        """Vectors of the length and the number of blanks."""

        dimensions = 2
        passage_prefix, query_prefix = "passage: ", "q: "

        def embed(self, texts):
            return np.array([[len(x), x.count(" ")] for x in texts], float)

    class Overlap:
        def score(self, questions, passages):
            return [len(set(q.split()) & set(p.split())) / 10 for q, p in zip(questions, passages, strict=True)]

    return Lengths, Overlap


Lengths, Overlap = models()


def test_prefixes_of_an_embedder(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    assert [r.vector for r in embed(rows, "t", Lengths).orderBy("i").collect()] == [[12.0, 2.0], [9.0, 1.0]]
    assert [r.vector for r in embed(rows, "t", Lengths, kind="query").orderBy("i").collect()] == [[6.0, 2.0], [3.0, 1.0]]


def test_scorer_of_a_model(spark):
    chunks = spark.createDataFrame([(1, 0, "x y"), (2, 0, "a b c"), (3, 0, "a")], "doc_id long, pos int, text string")
    queries = spark.createDataFrame([(7, "a b c d")], "query_id long, question string")
    rows = spark.createDataFrame([(7, d, 0, r, 0.0) for r, d in enumerate((1, 3, 2), 1)], "query_id long, doc_id long, pos int, rank int, score double")
    out = rerank.rerank(rows, queries, chunks, 3, batched(Overlap)).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in out] == [(2, 0.3), (3, 0.1), (1, 0.0)]


def test_json_repair(spark):
    raw = ['```json\n{"a": [1, 2,], "b": {"c": 3,},}\n```', 'Sure: {"a": [[1,],], "b": {"c": 4}} done', "no object", '{"a": [], }', None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    kind = "a string, b struct<c: int>"
    found = [r.o for r in rows.select("i", F.from_json(fn.json_object("x"), kind).alias("o")).orderBy("i").collect()]
    assert [(o.a, o.b and o.b.c) if o else None for o in found] == [("[1,2]", 3), ("[[1]]", 4), None, ("[]", None), None]


def test_keys_numbers_and_scalar_columns(spark):
    rows = spark.createDataFrame([(1, "12", ["a"]), (None, "x", None), (3, "-4", [])], "k int, n string, labels array<string>")
    assert [tuple(r) for r in rows.select(fn.key_text("k").alias("k"), fn.number("n").alias("n")).collect()] == [("1", 12), ("", None), ("3", -4)]
    assert enrich.scalar_columns(rows).columns == ["k", "n"]


def test_groups_without_an_id_come_last(spark):
    ranking = spark.createDataFrame([(1, "", 0, 1, 1.0), (1, "b", 0, 2, 0.5), (1, "a", 0, 3, 0.2)], "query_id long, doc_id string, pos int, rank int, score double")
    chunks = spark.createDataFrame([("", 0, "x"), ("b", 0, "y"), ("a", 0, "z")], "doc_id string, pos int, text string")
    assert [r.doc_id for r in chat.grouped_sources(ranking, chunks).orderBy("place").collect()] == ["a", "b", ""]
