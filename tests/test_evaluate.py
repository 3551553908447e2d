import hashlib
import re

import pytest
from pyspark.sql import Row

from corpusmill.operators import enrich, evaluate, groundtruth, scoring
from corpusmill.operators.graph import components


def test_summary_and_histogram_by_hand(spark):
    hits = spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("a", 12)], "cell string, first_hit int")
    assert evaluate.summary(hits, "cell").first() == Row(cell="a", hit_rate=0.75, mrr=0.3542, n=4)
    buckets = {r.rank_bucket: r["count"] for r in evaluate.histogram(hits, 10, "cell").collect()}
    assert len(buckets) == 11 and sum(buckets.values()) == 4
    assert (buckets["1"], buckets["3"], buckets["miss"], buckets["2"]) == (1, 1, 2, 0)


def test_first_hits(spark):
    chunks = spark.createDataFrame([(1, 0, "Foo  BAR baz"), (1, 1, "other"), (2, 0, "foo bar")], "doc_id long, pos int, text string")
    queries = spark.createDataFrame([(7, 1, "foo bar"), (8, 1, ""), (9, None, "foo bar")], "query_id long, reference long, gold_snippet string")
    rankings = spark.createDataFrame([(q, d, p, r) for q in (7, 8, 9) for r, (d, p) in enumerate([(2, 0), (1, 1), (1, 0)], 1)], "query_id long, doc_id long, pos int, rank int")
    assert {r.query_id: r.first_hit for r in evaluate.first_hits(rankings, queries, chunks).collect()} == {7: 3, 8: None, 9: None}


def test_pivot_keeps_order_and_blanks(spark):
    rows = spark.createDataFrame([("s1", "b", 0.5), ("s2", "a", 0.25)], "strategy string, retriever string, hit_rate double")
    out = evaluate.pivot(rows, "strategy", "retriever", ["b", "a"])
    assert out.columns == ["strategy", "b", "a"]
    assert {tuple(r) for r in out.collect()} == {("s1", 0.5, None), ("s2", None, 0.25)}


def test_containing_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "A  b c"), (2, "b C d"), (3, None)], "doc_id long, text string")
    snippets = spark.createDataFrame([(10, "B c"), (11, "x"), (12, ""), (13, "b c")], "query_id long, gold_snippet string")
    assert {tuple(r) for r in evaluate.containing(docs, snippets).collect()} == {(10, 1), (10, 2), (13, 1), (13, 2)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 50), (101, 50)], "a long, b long")
    out = {r.node: r.root for r in components(edges).collect()}
    assert all(out[i] == 1 for i in range(1, 31)) and out[100] == out[101] == out[50] == 50
    assert components(edges.where("a < 0")).count() == 0


def test_labels_fall_back(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, None), (3, [])], "doc_id long, labels array<string>")
    names = spark.createDataFrame([("a", "en", "A"), ("a", "fr", "Af"), ("b", "en", "B")], "label_id string, lang string, name string")
    out = {r.doc_id: r.labels_named for r in enrich.resolve_labels(docs, names, "fr").collect()}
    assert out == {1: ["Af", "B", "c"], 2: [], 3: []}


def test_violations(spark):
    docs = spark.createDataFrame([(None, "x"), ("a", ""), ("a", "y"), ("b", None)], "doc_id string, text string")
    assert tuple(enrich.violations(docs).first()) == (1, 2, 1)


def brute_snippet(text, key, seed=42, least=120, most=400):
    """The rules one after another, on the whole text."""
    drawn = lambda salt, n: int(hashlib.md5(f"{seed}|{salt}|{key}".encode()).hexdigest()[:8], 16) % n
    n = len(text)
    first = max(150, n // 6)
    room = min(n - most // 2, n * 5 // 6) - first
    if n < 500 or room <= 0:
        return None
    start = first + drawn("place", room)
    end = start + least + drawn("size", most - least + 1)
    borders = [m.end() for mark in (r"\. ", r"\.\n", r"\n\n") for m in re.finditer(f"(?={mark})..", text[start - 120 : start], re.DOTALL)]
    begin = start - 120 + max(borders) if borders else start
    stops = [i + 1 for mark in (". ", ".\n") if (i := text[end : end + 200].find(mark)) >= 0]
    found = re.sub(r"^[\W]+|[\W]+\Z", "", text[begin : min(n, end) + (stops[0] if stops else 0)])
    if len(found) > most:
        stop = found[:most].rfind(". ")
        found = found[: stop + 1] if stop + 1 >= least else found[:most].rstrip()
    return found if len(found) >= least else None


def test_snippets_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = ["", "short", ". ".join(f"Sentence number {i} of a longer text" for i in range(60)) + ".", "no marks at all " * 60, "A.\nB. C\n\nD " * 120, "x" * 5000, "..  \n" * 300]
    docs = docs.unionAll(spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(made)] + [(10_100, None)], "doc_id long, text string"))
    found = {r.doc_id: r.gold_snippet for r in groundtruth.snippets(docs).collect()}
    want = {r.doc_id: s for r in docs.collect() if (s := brute_snippet(r.text or "", r.doc_id)) is not None}
    assert found == want and len(found) > 50
    assert all(120 <= len(x) <= 400 for x in found.values())


def test_question_rules(spark):
    q = "Which seven unusual colours were painted on every second wooden door upstairs yesterday?"
    rows = spark.createDataFrame([(q, "doors and walls"), (q + "?", "x"), ("Short one?", "x"), (q, q)], "q string, s string")
    assert [r[0] for r in rows.select(groundtruth.question_passes("q", "s")).collect()] == [True, False, False, False]


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0.5, float("nan"), None), (2, 1.0, None, None), (3, None, None, "no_answer")], "id long, a double, b double, skip_reason string")
    assert [r[0] for r in rows.orderBy("id").select(scoring.overall_mean("a", "b")).collect()] == [0.5, 1.0, None]
    stats = {r.metric: (r["mean"], r.stdev, r.n) for r in scoring.statistics(rows, ["a", "b"]).collect()}
    assert stats["a"] == (0.75, 0.353553, 2) and stats["b"] == (None, None, 0)


def test_context_precision(spark):
    contexts = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "zzzzz"), (1, 3, "alphb")], "query_id long, rank int, text string")
    references = spark.createDataFrame([(1, "alpha")], "query_id long, reference_text string")
    assert scoring.context_precision(contexts, references).first()[1] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert scoring.context_recall(contexts, references).first()[1] == 1.0
