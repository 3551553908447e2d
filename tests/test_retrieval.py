import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fusion, rerank, search
from corpusmill.operators.models import HashingEmbedder
from corpusmill.plans import chat, retrieval

TEXTS = ["the cat sat", "the dog sat on the cat", "a bird", "dogs and cats", "the the the", "zebra"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "doc_id long, pos int, text string")


def ranking(spark, rows):
    return spark.createDataFrame([(1, d, 0, r, s) for d, r, s in rows], "query_id long, doc_id long, pos int, rank int, score double")


def ids(df):
    return [r.doc_id for r in df.orderBy("query_id", "rank").collect()]


def brute_bm25(question):
    docs = [t.split() for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    scores = [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in question.split() if w in d) for d in docs]
    return sorted(range(n), key=lambda i: (-round(scores[i], 8), i))


def test_bm25_ranks_all_documents(spark, chunks):
    queries = spark.createDataFrame([(1, "the cat cat"), (2, "nothing here")], "query_id long, question string")
    found = search.LexicalIndex(chunks).top(queries, 6)
    assert ids(found.where("query_id = 1")) == brute_bm25("the cat cat")
    assert ids(found.where("query_id = 2")) == list(range(6))


def test_nearest_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(3)
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    out = search.nearest(rows, asked, 7, "euclidean", ("vec_id",), "vec_id").collect()
    for q in range(0, 200, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(d)[:7].tolist()


def test_mmr_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(12, 4)), rng.normal(size=4)
    rows = spark.createDataFrame([(1, i, 0, i + 1, x.tolist()) for i, x in enumerate(v)], "query_id long, doc_id long, pos int, rank int, vector array<double>")
    asked = spark.createDataFrame([(1, q.tolist())], "query_id long, vector array<double>")
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q)
    taken = [int(np.argmax(u @ w))]
    while len(taken) < 5:
        value = [-np.inf if i in taken else 0.5 * u[i] @ w - 0.5 * max(u[i] @ u[j] for j in taken) for i in range(12)]
        taken.append(int(np.argmax(value)))
    assert ids(search.mmr(rows, asked, 5)) == taken


def test_fusion_by_hand(spark):
    dense, lexical = ranking(spark, [(10, 1, 0.1), (20, 2, 0.2)]), ranking(spark, [(20, 1, 5.0), (30, 2, 4.0)])
    rrf = fusion.reciprocal_rank(dense, lexical, 3).orderBy("rank").collect()
    assert [r.doc_id for r in rrf] == [20, 10, 30]
    assert rrf[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-7)
    assert ids(fusion.interleaved(dense, lexical, 3)) == [10, 20, 30]
    assert ids(fusion.padded(fusion.head(dense, 1), [lexical], 3)) == [10, 20, 30]


def test_fill_takes_five_dense_first(spark):
    dense, lexical = ranking(spark, [(i, i, 1.0) for i in range(1, 11)]), ranking(spark, [(100 + i, i, 1.0) for i in range(1, 21)])
    assert ids(fusion.filled(dense, lexical, 10)) == [1, 2, 3, 4, 5, 101, 102, 103, 104, 105]


def test_scaled(spark):
    def run(values):
        rows = spark.createDataFrame([(1, float(v)) for v in values], "query_id long, v double")
        return dict((r.v, r.s) for r in rows.withColumn("s", fusion.scaled(F.col("v"))).collect())

    assert run([2, 4, 0, -1]) == {2.0: 0.0, 4.0: 1.0, 0.0: 0.0, -1.0: 0.0}
    assert run([3, 0]) == {3.0: 1.0, 0.0: 0.0}


def test_relevance_threshold(spark):
    rows = ranking(spark, [(1, 1, 1.0), (2, 2, 0.5), (3, 3, 0.2), (4, 4, None)])
    assert ids(rerank.relevant(rows)) == [1, 2]
    assert ids(rerank.relevant(ranking(spark, [(1, 1, 0.5), (2, 2, 0.5)]))) == [1, 2]


def test_neighbours(spark):
    chunks = spark.createDataFrame([(5, p, str(p)) for p in range(3)], "doc_id long, pos int, text string")
    out = rerank.with_neighbours(ranking(spark, [(5, 1, 1.0)]), chunks).orderBy("rank").collect()
    assert [r.pos for r in out] == [0, 1, 2]


def test_citations(spark):
    rows = ranking(spark, [(7, 1, 1.0), (8, 2, 1.0), (9, 3, 1.0)])
    answers = spark.createDataFrame([(1, "see [2] and [2][5], [x]")], "query_id long, answer string")
    assert ids(chat.resolve_citations(answers, rows)) == [8]
    assert ids(chat.resolve_citations(answers.withColumn("answer", F.lit("none")), rows)) == [7, 8, 9]


def test_retriever_names():
    assert len(retrieval.RETRIEVERS) == 20
    assert retrieval.base_of("bm25_k10_ce_r50") == "bm25_k10"
    assert retrieval.dense_only("dense_mmr_k10_ce_r50") and not retrieval.dense_only("bm25_k10")
    assert retrieval.parse_pairs("len_500_o50:bm25_k10, a:hyb_rrf_k60") == [("len_500_o50", "bm25_k10"), ("a", "hyb_rrf_k60")]
    with pytest.raises(ValueError):
        retrieval.checked(["nope"])


def test_all_retrievers_have_distinct_full_ranks(spark, chunks):
    queries = spark.createDataFrame([(1, "the cat"), (2, "zebra bird")], "query_id long, question string")
    lists = retrieval.Lists.of(queries, chunks)
    rows = retrieval.grid({"x": lists}, list(retrieval.RETRIEVERS), 4).groupBy("retriever", "query_id").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.max("rank").alias("m")
    ).collect()
    assert len(rows) == 40 and {(r.n, r.d, r.m) for r in rows} == {(4, 4, 4)}
    assert ids(lists.chat("bm25_k10").where("query_id = 2"))[0] in (2, 5)


def test_hashing_embedder_is_stable():
    a, b = HashingEmbedder().embed(["one two", "two one"])
    assert (a == b).all() and abs(a).sum() == 2
