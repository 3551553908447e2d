"""Stores, pairs, stored questions, answers and the grid of all chunkings, against brute force on small corpora."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, dedup, evaluate, search
from corpusmill.operators.models import coverage
from corpusmill.plans import campaign, retrieval, store
from corpusmill.sources import tables

TEXTS = [
    "The cat sat on the mat.\n\nThe dog barked at the moon. " * 3,
    "Ships come into the harbour in the evening.\n\nThe harbour lights are green. " * 3,
    "Seven unusual colours were painted on the wooden door upstairs.",
    "",
    "The cat sat on the mat and the moon was green over the harbour.",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "the cat on the mat", "the cat sat on the mat"), (2, "green harbour lights", "harbour lights are green"), (3, "zebra", "zebra")]
    return spark.createDataFrame(rows, "query_id long, question string, gold_snippet string")


@pytest.fixture(scope="module")
def lists(docs, queries):
    return campaign.lists_by_strategy(docs, queries, ["line_n_merge", "len_500_o50", "para_nn_merge"])


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_grid_is_every_cell_on_its_own(lists):
    got = {}
    for r in retrieval.grid(lists, list(retrieval.RETRIEVERS), 3).collect():
        got.setdefault((r.strategy, r.retriever), []).append((r.query_id, r.rank, r.doc_id, r.pos))
    assert len(got) == 60
    for strategy, own in lists.items():
        for r in retrieval.RETRIEVERS if strategy == "len_500_o50" else ("dense_mmr_k10_ce_r50", "hyb_interleave"):
            assert sorted(got[strategy, r]) == rows_of(own.run(r, 3), "query_id", "rank", "doc_id", "pos"), (strategy, r)


def test_strict_grid_needs_full_lists(lists):
    assert retrieval.grid(lists, ["bm25_k10"], 4, strict=True).count() == 3 * 3 * 4
    with pytest.raises(ValueError, match="fewer than 10"):
        retrieval.grid(lists, ["bm25_k10"], 10, strict=True)


def test_dense_retrievers_make_no_lexical_list(docs, queries):
    own = retrieval.Lists.of(queries, chunking.chunk(docs, ["line_n_merge"]))
    assert own.run("dense_sim_k10", 3).count() == 9
    assert retrieval.grid({"x": own}, ["dense_sim_k10_ce_r50"], 3).count() == 9
    assert "lexical" not in own.__dict__ and "index" not in own.corpus.__dict__
    other = retrieval.Lists.of(queries, chunking.chunk(docs, ["line_n_merge"]))
    assert other.base("bm25_k10", 2).count() == 6 and "vectors" not in other.corpus.__dict__


def test_multi_query_by_brute_force(spark, lists, queries):
    own = lists["line_n_merge"]
    variants = spark.createDataFrame([(1, ["moon dog", "harbour"]), (2, []), (3, None)], "query_id long, variants array<string>")
    got = retrieval.multi_query(variants, own, "bm25_k10", 3, each=2)
    texts = {(r.doc_id, r.pos): r.text for r in own.chunks.collect()}
    asked = {r.query_id: r.question for r in queries.collect()}
    extra = {1: ["moon dog", "harbour"], 2: [], 3: []}
    score = spark.createDataFrame([(q, d, p, asked[q], t) for q in asked for (d, p), t in texts.items()], "q long, d long, p int, a string, t string")
    score = {(r.q, r.d, r.p): r.s for r in score.select("q", "d", "p", F.round(coverage("a", "t"), 8).alias("s")).collect()}
    for q in asked:
        pool = []
        for i, one in enumerate([asked[q], *extra[q]]):
            part = search.LexicalIndex(own.chunks).top(spark.createDataFrame([(i, one)], "query_id long, question string"), 2).orderBy("rank").collect()
            pool += [(r.doc_id, r.pos) for r in part if (r.doc_id, r.pos) not in pool]
        want = sorted(pool, key=lambda k: (-score[(q, *k)], pool.index(k)))[:3]
        assert [(r.doc_id, r.pos) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_nearest_keeps_a_running_list(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(5000, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(f"d{i % 97}", i, v.tolist()) for i, v in enumerate(x)], "doc_id string, pos long, vector array<double>").repartition(2)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:5])], "query_id long, vector array<double>")
    out = search.nearest(rows, asked, 20, "euclidean").collect()
    for q in range(5):
        d = np.round(((x - x[q]) ** 2).sum(axis=1), 8)
        want = sorted(range(5000), key=lambda i: (d[i], f"d{i % 97}", i))[:20]
        assert [r.pos for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_pairs(spark):
    assert campaign.strategies_of(campaign.PAIRS) == ["len_1000_o100", "len_1500_o150", "len_500_o50", "rec_nn_priority", "len_2000_o200"]
    assert campaign.with_reranker(campaign.PAIRS)[-1] == ("len_2000_o200", "hyb_interleave_ce_r50") and campaign.with_reranker(campaign.PAIRS)[:9] == list(campaign.PAIRS[:9])
    assert campaign.pairs_fingerprint(spark, campaign.PAIRS) == hashlib.sha256("\n".join(f"{s}::{r}" for s, r in campaign.PAIRS).encode()).hexdigest()


def test_rankings_of_kept_documents(spark, docs, queries):
    twice = docs.unionAll(spark.createDataFrame([(9, TEXTS[0])], "doc_id long, text string"))
    keep = dedup.keepers(dedup.groups(twice).withColumn("year", F.lit(1)), "year")
    left = campaign.kept(twice, keep)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4]
    lists = campaign.lists_by_strategy(left, queries, ["line_n_merge"])
    rows = campaign.rankings(lists, [("line_n_merge", "bm25_k10")], 3)
    hits = campaign.first_hits(rows, evaluate.with_reference(queries, left).where("reference is not null"), lists)
    assert {r.query_id: r.first_hit for r in hits.collect()} == {1: 1, 2: 1}


def test_questions_are_made_once(spark, queries):
    targets = spark.createDataFrame([("a", 60), ("b", 250)], "strategy string, target_words int")
    stored = spark.createDataFrame([("a", 1, "x", "kept as it is", 60, ["u", "v"])], "strategy string, query_id long, original_question string, enhanced_question string, target_words int, variants array<string>")
    rows = campaign.stored_questions(queries, targets, stored)
    assert rows.count() == 6 and rows.where("enhanced_question = 'kept as it is'").count() == 1
    assert campaign.required(rows, queries, ["a", "b"]).count() == 6
    with pytest.raises(ValueError, match="b \\(3\\)"):
        campaign.required(stored.unionAll(rows.where("strategy = 'a' and query_id > 1")), queries, ["a", "b"])
    assert all(len(r.variants) == 2 for r in rows.collect())


def test_question_and_variant_rankings(spark, lists, queries):
    targets = spark.createDataFrame([("line_n_merge", 60)], "strategy string, target_words int")
    questions = campaign.stored_questions(queries, targets)
    own = {"line_n_merge": lists["line_n_merge"]}
    for rows in (campaign.question_rankings(own, [("line_n_merge", "bm25_k10")], questions, 3), campaign.variant_rankings(own, [("line_n_merge", "hyb_interleave")], questions, 3), campaign.neighbour_rankings(own, [("line_n_merge", "bm25_k10")], 3)):
        assert {(r.query_id, r["count"]) for r in rows.groupBy("query_id").count().collect()} == {(1, 3), (2, 3), (3, 3)}
        assert {r.retriever for r in rows.select("retriever").distinct().collect()} <= {"bm25_k10_ce_r50", "hyb_interleave_ce_r50"}


def test_answers(spark, lists, queries, docs):
    own = lists["line_n_merge"]
    inputs = campaign.model_inputs(own.run("bm25_k10", 2), queries, own.chunks)
    gold = evaluate.with_reference(queries, docs)
    done = spark.createDataFrame([(3,)], "query_id long")
    rows = {r.query_id: r for r in campaign.responses(inputs, gold, done=done).collect()}
    assert rows.keys() == {1, 2}
    assert rows[1].reference == 0 and rows[1].reference_contexts == ["the cat sat on the mat"] and rows[1].n_documents == 2
    first = rows[2].documents[0].text
    assert rows[2].answer == first.split(". ")[0].split(".\n")[0] + "." and [d["rank"] for d in rows[2].documents] == [1, 2]


def test_first_accepted_is_a_loop_that_stops(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(50)], "doc_id long, ok boolean")
    got = campaign.first_accepted(rows, 4, F.col("ok")).orderBy("turn").collect()
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert [(r.turn, r.doc_id) for r in got] == [(t, i) for t, i in enumerate(order, 1) if i % 3 == 0][:4]


def test_score_table_has_fixed_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "x")], "id long, m double, extra string")
    campaign.score_table(rows, ["id", "skip", "m"], str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert back.columns == ["id", "skip", "m"] and tuple(back.first()) == ("1", None, "0.5")


def test_vector_store_continues(spark, docs, tmp_path):
    chunks = chunking.chunk(docs, ["line_n_merge"])
    kept = store.VectorStore(spark, str(tmp_path / "v"))
    assert kept.read("line_n_merge") is None and kept.state(chunks, "line_n_merge") == "build"
    assert kept.fill(chunks.where("doc_id < 2"), "line_n_merge") == "build"
    assert kept.fill(chunks, "line_n_merge") == "resume"
    assert kept.fill(chunks, "line_n_merge") == "skip"
    assert kept.fill(chunking.chunk(docs, ["len_500_o50"]), "len_500_o50") == "build"
    stored = kept.read("line_n_merge")
    assert rows_of(stored, "chunk_uid") == rows_of(chunks, "chunk_uid") and len(stored.first().vector) == 64
    fewer = chunks.where("doc_id <> 2")
    assert kept.fill(fewer, "line_n_merge") == "rebuild"
    assert rows_of(kept.read("line_n_merge"), "chunk_uid") == rows_of(fewer, "chunk_uid")
    assert kept.read("len_500_o50").count() == chunking.chunk(docs, ["len_500_o50"]).count()


def test_manifest(spark, docs, tmp_path):
    path = str(tmp_path / "m")
    assert not store.manifest_is_current(docs, path)
    store.write_manifest(docs, path)
    assert store.manifest_is_current(docs, path) and not store.manifest_is_current(docs, path, 3) and not store.manifest_is_current(docs.where("doc_id > 0"), path)
    assert rows_of(store.read_manifest(spark, path), "doc_id") == [(i,) for i in range(5)]
    store.write_manifest(docs, path, 2)
    assert store.manifest_is_current(docs, path, 2) and rows_of(store.read_manifest(spark, path), "doc_id") == [(0,), (1,)]
    assert store.read_meta(spark, f"{path}/meta")["n_docs"] == "2"


def test_candidates_are_read_with_the_same_settings(spark, lists, queries, tmp_path):
    path, own = str(tmp_path / "c"), lists["line_n_merge"]
    meta = {"ground_truth": "gt", "ground_truth_sha256": store.fingerprint(queries), "manifest": "m", "manifest_sha256": "0", "pairs_fingerprint": "p", "limit_queries": None, "final_k": 20, "candidate_k": 100}
    rows = own.candidates("hyb_interleave").select(F.lit("line_n_merge").alias("strategy"), F.lit("hyb_interleave").alias("retriever"), "*")
    store.write_candidates(rows, path, "eval1", meta)
    back = store.read_candidates(spark, path, "eval1", meta)
    assert rows_of(back, "query_id", "rank", "doc_id", "pos") == rows_of(rows, "query_id", "rank", "doc_id", "pos")
    assert rows_of(store.stored_queries(back), "strategy", "retriever", "n") == [("line_n_merge", "hyb_interleave", 3)]
    assert rows_of(own.finalize(back, 3), "query_id", "rank", "doc_id", "pos") == rows_of(own.finalize(rows, 3), "query_id", "rank", "doc_id", "pos")
    for wrong in ({"final_k": 10}, {"neighbor_offsets": "[-1, 1]"}, {"limit_queries": 5}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            store.read_candidates(spark, path, "eval1", meta | wrong)
    with pytest.raises(ValueError, match="version"):
        store.read_candidates(spark, path, "eval2", meta)


def test_fingerprint_depends_on_rows_alone(spark, queries):
    assert store.fingerprint(queries) == store.fingerprint(queries.repartition(3).orderBy(F.col("query_id").desc()))
    assert store.fingerprint(queries) != store.fingerprint(queries.unionAll(queries.limit(1))) != store.fingerprint(queries.where("false"))


def test_unfinished_cells(spark):
    cells = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "strategy string, retriever string")
    done = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 2, None), ("a", "y", 1, 1), ("b", "x", 1, 1), ("b", "x", 1, 1)], "strategy string, retriever string, query_id long, first_hit int")
    left = lambda *x: rows_of(store.unfinished(cells, *x), "strategy", "retriever")
    assert left(done, 2) == [("a", "y"), ("b", "x")]
    assert left(None, 2) == left(done, 2, {"k": "1"}, {"k": 2}) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert left(done, 2, {"k": "1"}, {"k": 1}) == [("a", "y"), ("b", "x")]


def test_ground_truth_file(spark, tmp_path):
    path = tmp_path / "gt.jsonl"
    path.write_text('{"id": "q1", "question": "a?", "reference": "d", "gold_snippet": "s", "source_len_chars": 3}\n\n{"id": "q2", "question": "b?", "reference": "e", "gold_snippet": "t"}\n')
    assert rows_of(tables.ground_truth(spark, str(path)), "query_id", "reference") == [("q1", "d"), ("q2", "e")]


def test_last_row_of_equal_order(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "z"), (2, None, "c")], "k int, o int, v string")
    assert rows_of(tables.last_by_key(rows, "k", "o"), "k", "o", "v") == [(1, 2, "b"), (2, None, "c")]


def test_bag_of_words_and_nfkc(spark):
    from corpusmill.functions import text as fn

    values = ["ﬁne Ⅳ", "plain", None, "", "ｆｕｌｌ width"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in df.select("i", fn.nfkc("v").alias("n")).orderBy("i").select("n").collect()] == ["fine IV", "plain", None, "", "full width"]
    assert [r[0] for r in df.limit(1).select(fn.normalize(F.lit("a  b　\x0bc \n"))).collect()] == ["a b c"]
