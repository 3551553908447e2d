"""Steps whose shuffles and memory must not grow faster than their input."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, dedup, groundtruth, models, search
from corpusmill.sources.tables import documents


def rows_of(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_meet_no_postings_in_a_shuffle(spark):
    queries = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "query_id long, question string")
    found = search.LexicalIndex(rows_of(spark, ["aa bb", "bb cc", "dd"])).top(queries, 2)
    assert "Join" not in logical(found) and "Aggregate" not in logical(found)
    assert [(r.query_id, r["rank"], r.doc_id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)]


def test_chunks_without_a_shared_term_rank_above_negative_scores(spark):
    queries = spark.createDataFrame([(1, "xx")], "query_id long, question string")
    found = search.LexicalIndex(rows_of(spark, ["xx yy", "xx yy", "xx yy", "zz"])).top(queries, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score < 0) for r in found] == [(3, False), (0, True)]


def test_blocks_of_questions_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 12) % 60) for _ in range(700)]
    asked = {i: f"w{i} w1 w1 w{i + 7} none" for i in range(9)}
    docs = [Counter(t.split()) for t in texts]
    n, average = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if v < 0 else v for w, v in raw.items()}
    monkeypatch.setattr(search, "QUESTION_BLOCK", 4)
    found = search.LexicalIndex(rows_of(spark, texts).repartition(3)).top(spark.createDataFrame(list(asked.items()), "query_id long, question string"), 5).collect()
    for q, question in asked.items():
        score = [sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average)) for w in question.split() if w in c) for c in docs]
        want = sorted(range(n), key=lambda i: (-round(score[i], 8), i))[:5]
        got = sorted((r["rank"], r.doc_id, r.score) for r in found if r.query_id == q)
        assert [d for _, d, _ in got] == want and [s for *_, s in got] == pytest.approx([score[d] for d in want], abs=1e-7)


def brute_pairs(texts, threshold):
    docs = {}
    for i, t in enumerate(texts):
        docs.setdefault(t, i)
    bags = {i: Counter(t.split()) for t, i in docs.items()}
    copies = {i: texts.count(t) for t, i in docs.items()}
    df = Counter()
    for i, bag in bags.items():
        for w in bag:
            df[w] += copies[i]
    vectors = {}
    for i, bag in bags.items():
        v = {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[i] = {w: x / length for w, x in v.items()}
    cosine = {(a, b): round(sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()), 6) for a in vectors for b in vectors if a < b}
    return {k: v for k, v in cosine.items() if v > threshold}


@pytest.mark.parametrize("keyed, block", [(32, 3_000_000), (4, 300)])
def test_similar_pairs_by_all_ways(spark, monkeypatch, keyed, block):
    """Short and long documents, near copies of both, single words, copies: whichever way two documents meet."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{int(x)}" for x in rng.zipf(1.25, n) % 4000]
    texts = [" ".join(word(int(n))) for n in rng.integers(3, 60, 50)] + [" ".join(word(400)) for _ in range(12)]
    for t in list(texts[::3]):
        ws = t.split()
        for _ in range(int(rng.integers(1, 4))):
            ws[int(rng.integers(len(ws)))] = word(1)[0]
        texts += [" ".join(ws), t]
    texts += ["solo", "solo solo", "solo mono", "", "w1", "w1 w1 w2"]
    monkeypatch.setattr(dedup, "KEYED", keyed)
    monkeypatch.setattr(dedup, "BLOCK_TERMS", block)
    monkeypatch.setattr(dedup, "CELLS", 40)
    monkeypatch.setattr(dedup, "STEP", 50)
    monkeypatch.setattr(dedup, "BATCH_WORDS", 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {(r.a, r.b): r.cosine for r in dedup.similar_pairs(dedup.representatives(docs), 0.9).collect()}
    want = brute_pairs(texts, 0.9)
    assert found.keys() == want.keys() and len(want) > 15
    assert [found[k] for k in sorted(found)] == pytest.approx([want[k] for k in sorted(want)], abs=2e-6)


def test_one_common_prefix_term_makes_no_candidates(spark):
    """Sixty texts that share a rare word and nothing else: a pair of each two of them before."""
    texts = [" ".join(["shared", *(f"x{i}y{j}" for j in range(30)), *(f"x{i // 2}z{j}" for j in range(5))]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = dedup.weights(dedup.representatives(docs)).select("doc_id", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"), "dfs", "shared", "weights")
    assert dedup.candidates(hashed, 0.95).count() <= 30


def test_snippets_are_looked_for_beside_their_texts(spark, sf):
    docs = documents(spark, sf)
    names = ["line_n_merge", "len_500_o50", "para_nn_merge"]
    found = groundtruth.in_every_chunking(docs, names)
    assert "Join" not in logical(found)
    want = groundtruth.in_every_strategy(groundtruth.snippets(docs), chunking.chunk(docs, names), 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in want.collect()) != []


def test_named_chunks_are_fetched_without_a_shuffle_of_texts(spark, monkeypatch):
    chunks = rows_of(spark, ["aa", "bb", "cc", "dd"])
    keys = spark.createDataFrame([(1, 0), (1, 0), (3, 0), (9, 0)], "doc_id long, pos int")
    monkeypatch.setattr(search, "WANTED", 3)
    few = search.fetched(keys, chunks)
    assert sorted(r.text for r in few.collect()) == ["bb", "dd"]
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "WANTED", 2)
    assert sorted(r.text for r in search.fetched(keys, chunks).collect()) == ["aa", "bb", "cc", "dd"]


def test_embedder_forgets_places_and_gives_the_same_vectors(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(20)]
    want = models.HashingEmbedder().embed(texts)
    monkeypatch.setattr(models, "PLACES", 16)
    small = models.HashingEmbedder()
    assert (small.embed(texts) == want).all() and len(small.places) <= 16


def test_chunks_that_can_have_a_snippet(spark):
    docs = spark.createDataFrame([(1, "ONE Kettle\n\ntwo", "a kettle, é"), (2, "é\n\nü", "é ü"), (3, "xx\n\nyy", None)], "doc_id long, text string, s string")
    spec = chunking.ChunkSpec("p", lambda text: text.split("\n\n"), ())
    found = chunking.chunk(docs, [spec], ("s",), having="s").orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in found] == [(1, 0, "ONE Kettle"), (2, 0, "é"), (2, 1, "ü"), (3, 0, "xx"), (3, 1, "yy")]
