import numpy as np
import pytest

from corpusmill.llm import toxicity

TEXT = "doc_id long, text string, severity int"
LABELS = "doc_id long, quality int, toxic int"


def test_word_features():
    assert toxicity.word_features(b"abcd") == [b"abcd", b"abc*", b"abcd*"]


def test_gradient_of_the_likelihood():
    """One step of the fit lowers the loss, and the thresholds stay in order."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    grades = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=300), [-1, 0.5, 2])
    row, column = np.repeat(np.arange(300), 3), np.tile(np.arange(3), 300)
    model = toxicity.Ordinal(3).fit(row, column, x.ravel(), grades)
    assert model.weights[0] == pytest.approx(2, abs=0.6) and model.weights[1] == pytest.approx(-1, abs=0.4) and abs(model.weights[2]) < 0.3
    assert list(model.thresholds) == sorted(model.thresholds)
    assert np.allclose(model.thresholds, [-1, 0.5, 2], atol=0.6)


def test_expected_severity_is_the_sum_over_grades():
    model = toxicity.Ordinal(1)
    above = model.above(1.5)
    grades = -np.diff([1.0, *above, 0.0])
    assert sum(above) == pytest.approx(sum(k * p for k, p in enumerate(grades)))


def test_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels.where("doc_id % 4 <> 0")).collect()
    assert len(rows) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 0").collect()}
    held = [r for r in rows if toxic.get(r.doc_id) is not None]
    hit = [r.toxic for r in held if toxic[r.doc_id]]
    wrong = [r.toxic for r in held if not toxic[r.doc_id]]
    assert hit and np.mean(hit) >= 0.6 and np.mean(wrong) <= 0.03
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in rows)


def test_severity_of_labels_gives_the_grades(spark):
    """A severe text of few words ranks above a mild one of many, which grades by counts couldn't say."""
    kinds = ["calm and nice words", "mild mild mild mild mild mild", "bad word", "vile"]
    rows = [(i, f"{kinds[i % 4]} filler{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), i % 4) for i in range(400)], "doc_id long, toxic int, severity int")
    by = {r.doc_id: r.severity for r in toxicity.score(docs, labels).collect()}
    assert by[0] < 0.5 < by[1] < by[2] < by[3]
    want = np.mean([abs(by[i] - i % 4) for i in range(400)])
    assert want < 0.5


def test_an_id_with_very_many_rows_does_not_grow_the_sample(spark):
    rows = [(1, f"calm text {i}") for i in range(3000)] + [(2, f"awful text {i}") for i in range(3000)] + [(i, "awful x" if i % 2 else "calm x") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), *[(i, i % 2) for i in range(3, 60)]], "doc_id long, toxic int")
    out = toxicity.score(docs, labels, train=100).collect()
    assert len(out) == len(rows) and all(r.toxic == (r.doc_id == 2 or (r.doc_id > 2 and r.doc_id % 2 == 1)) for r in out)


def test_score_by_brute_force(spark, sf):
    """Every result from the fitted weights by the formula, on whole texts."""
    import re

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    features, model = toxicity.fit(docs, labels)
    at = {f: i for i, f in enumerate(features)}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score(docs, labels).collect():
        times = {}
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", texts[r.doc_id].encode().lower()):
            for f in [w, *(w[:n] + b"*" for n in range(3, 11) if n <= len(w))]:
                if f in at:
                    times[f] = times.get(f, 0) + 1
        score = sum(model.weights[at[f]] * (1 + np.log(n)) for f, n in times.items())
        p = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert r.n_features == sum(times.values())
        assert (r.severity, r.p_toxic) == (pytest.approx(sum(p)), pytest.approx(p[0])) and r.toxic == (p[0] >= 0.5)


def test_edges(spark):
    rows = [(i, "bad awful words" if i % 3 == 0 else "nice calm words", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (None, "bad awful", 1), (102, "bad awful", 1), (102, "bad awful", 1), (103, "nice " * 100_000 + "bad awful", 1)]
    docs = spark.createDataFrame(rows, TEXT)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (1, 1, None), (3, 0, 0), (100, None, 0)], LABELS)
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[0].toxic and by[None].toxic and by[102].toxic and by[103].n_features == by[0].n_features
    assert not by[1].toxic and by[100].severity == by[101].severity < by[0].severity and by[100].n_features == 0
    assert {r.severity for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.severity for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), labels).count() == 0
