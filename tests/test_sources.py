import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as fn
from corpusmill.operators import chunking, dedup, enrich
from corpusmill.plans import retrieval
from corpusmill.sources import tables


def test_jsonl_skips_blank_lines_and_limits_by_key(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"doc_id": "b", "text": "two", "labels": ["l"]}\n\n{"doc_id": "a", "text": "one", "labels": []}\n')
    rows = tables.read_jsonl(spark, str(path), tables.DOCUMENT, "doc_id", 1).collect()
    assert [(r.doc_id, r.text, r.labels) for r in rows] == [("a", "one", [])]
    assert tables.read_jsonl(spark, str(path), tables.DOCUMENT).count() == 2


def test_artifacts_by_suffix(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    items = [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    (tmp_path / "a.json").write_text(json.dumps({"items": items}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(items))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, items)))
    for name in ("a.json", "b.json", "c.jsonl"):
        assert {tuple(r) for r in tables.read_artifact(spark, str(tmp_path / name), schema).collect()} == {("a", 1), ("b", 2)}


def test_label_dictionary(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"1": {"en": "one", "fr": "un"}, "2": {"en": "two"}}))
    assert {tuple(r) for r in tables.read_label_dictionary(spark, str(tmp_path / "d.json")).collect()} == {("1", "en", "one"), ("1", "fr", "un"), ("2", "en", "two")}


def test_last_row_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, line int, v string")
    assert {(r.id, r.v) for r in tables.last_by_key(rows, "id", "line").collect()} == {("a", "y"), ("b", "z")}


def test_chunks_round_trip_by_partition(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one\ntwo")], "doc_id string, text string")
    tables.write_chunks(chunking.chunk(docs, ["line_n_merge", "len_500_o50"]), str(tmp_path / "chunks"))
    back = tables.read_chunks(spark, str(tmp_path / "chunks"), "len_500_o50")
    assert "PartitionFilters: [isnotnull(strategy" in back._jdf.queryExecution().toString()
    assert [r.text for r in back.collect()] == ["one\ntwo"]


def test_csv_and_appended_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "retriever string, hit_rate double")
    tables.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().hit_rate == "0.5"
    for _ in range(2):
        tables.append_jsonl(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_unfinished_cells(spark):
    cells = spark.createDataFrame([("a", "x"), ("a", "y")], "strategy string, retriever string")
    done = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "strategy string, retriever string, query_id long")
    assert [tuple(r) for r in retrieval.unfinished(cells, done).collect()] == [("a", "y")]


def test_text_functions(spark):
    def one(expression, **values):
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression).first()[0]

    assert one(fn.normalize("t"), t="  A \n b\t") == "a b"
    assert one(fn.nfkc("t"), t="ﬁ①") == "fi1"
    assert one(fn.title("t"), t="x" * 60) == "x" * 45 + "…"
    assert one(fn.title("t"), t="a  b") == "a b"
    assert one(fn.clipped_within("t", 4), t="abcdef") == "abc…"
    assert one(fn.cited_ranks("t"), t="see [2] and [2][5], [x]") == [2, 5]
    assert one(fn.json_object("t"), t='```json\n{"a": [1, 2,],}\n```') == '{"a": [1, 2]}'
    assert one(fn.block_text("t"), t='[{"type": "text", "text": "hi "}, {"type": "text", "text": "you"}]') == "hi you"
    assert one(fn.block_text("t"), t="[{'type': 'text', 'text': 'hi'}]") == "hi"
    assert one(fn.block_text("t"), t="plain") == "plain"
    assert one(fn.half_split("t"), t="One two. Three four. Five six.") == ["One two.", "Three four. Five six."]
    assert one(fn.half_split("t"), t="a b c d") == ["a b", "c d"]
    assert one(fn.document_key("u", "d", "t"), u="", d="7", t="A  b") == "7|a b"
    assert one(fn.document_url("http://x/", "t"), t="") == ""
    assert one(fn.passage("t"), t="x") == "passage: x" and one(fn.query("t"), t="x") == "query: x"


def test_payload_functions(spark):
    def one(expression, **values):
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression).first()[0]

    texts = F.array(F.lit(" a "), F.lit("  "), F.lit(None).cast("string"), F.lit("abcdef"))
    assert one(fn.truncated_texts(texts, 3)) == ["a", "abc\n[truncated]"]
    assert one(fn.reference_texts(texts, F.lit("gold"))) == ["a", "abcdef"]
    none = F.lit(None).cast("array<string>")
    assert one(fn.reference_texts(none, F.lit(" gold "))) == ["gold"] and one(fn.reference_texts(none, F.lit(" "))) == []
    pair = lambda *x: one(fn.variant_pair(F.array(*map(F.lit, x))))
    assert pair(" the first one", "the second one", "x") == ["the first one", "the second one"]
    assert pair("the first one", "THE FIRST ONE") is None and pair("the first one", "short") is None and pair("the first one") is None
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    age = lambda t: one(fn.relative_time(F.lit(t).cast("timestamp"), now))
    assert [age(t) for t in ("2024-01-09 23:59:30", "2024-01-09 23:15:00", "2024-01-09 03:00:00", "2024-01-06 00:00:00", "2024-01-02 00:00:00")] == ["Just now", "45m ago", "21h ago", "4d ago", "Jan 2"]
    assert one(fn.cell_key("a", "b"), a="x", b="y") == "x::y"


def test_stored_or_live(spark):
    schema = "query_id long, doc_id long, pos int, rank int, score double"
    stored, live = spark.createDataFrame([(1, 5, 0, 1, 0.5), (9, 5, 0, 1, 0.5)], schema), spark.createDataFrame([(1, 6, 0, 1, 0.1), (2, 7, 0, 1, 0.2)], schema)
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert sorted((r.query_id, r.doc_id) for r in retrieval.stored_or_live(queries, stored, live).collect()) == [(1, 5), (2, 7)]


def test_legal_ids(spark):
    rows = spark.createDataFrame([("31997R2316",), ("32004R2234R(01)",), ("bad",), (None,)], "id string")
    out = [tuple(r) for r in rows.select(*(c.alias(n) for n, c in fn.legal_id("id").items())).collect()]
    assert out == [(3, 1997, "R", "2316", None, False), (3, 2004, "R", "2234", "01", True), *[(None, None, None, None, None, False)] * 2]


def test_similar_pairs_equal_brute_force(spark):
    import itertools
    import math
    from collections import Counter

    texts = ["aa bb cc dd ee ff gg hh ii jj", "aa bb cc dd ee ff gg hh ii kk", "aa bb cc dd ee ff gg hh ii jj", "xx yy zz", "xx yy zz ww", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = {0: texts[0], 1: texts[1], 3: texts[3], 4: texts[4], 5: ""}
    df = Counter(w for t in texts for w in set((t or "").split()))
    vectors = {}
    for i, t in reps.items():
        v = {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in Counter(t.split()).items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[i] = {w: x / n for w, x in v.items()}
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) > 0.6}
    assert {(r.a, r.b) for r in dedup.similar_pairs(dedup.representatives(docs), 0.6).collect()} == want != set()
    grouped = dedup.groups(docs, 0.6)
    assert {r.doc_id: r.component for r in grouped.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}
    years = spark.createDataFrame([(0, 2001), (1, 2003), (2, 2003), (3, None), (4, None), (5, 1), (6, None)], "doc_id long, year int")
    assert {r.doc_id for r in dedup.keepers(grouped.join(years, "doc_id"), "year").collect()} == {1, 3, 5}
    assert tuple(dedup.statistics(grouped).first()) == (7, 3, 3, 4)
    assert {r.doc_id: r.group_id for r in dedup.dense_group_id(grouped).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


def test_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e")], "conv_id long, turn long, role string, text string")
    assert {(r.user, r.assistant) for r in enrich.paired_turns(rows).collect()} == {("a", "b"), ("d", "e")}
    assert {r.turn for r in enrich.recent_turns(rows, 2, F.col("text")).collect()} == {3, 4}
