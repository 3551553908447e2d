"""Registered queries: one for each operator, over whole tables, with whole-number columns as longs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators import chunking, dedup, enrich, evaluate, fusion, groundtruth, rerank, scoring, search
from corpusmill.operators.models import HashingEmbedder, coverage, embed, template_question
from corpusmill.plans import campaign, chat, retrieval
from corpusmill.sources.shared import materialize, stamp
from corpusmill.sources.tables import benchmark_queries, documents, last_by_key, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STRATEGY = "line_n_merge"
#: Depth of lists in the registered queries.
K, POOL = 10, 50


def query(f: Query) -> Query:
    """Register f by its name; 32-bit integers become longs, as SQL engines count."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

    QUERIES[f.__name__] = run
    return f


def chunks_of(spark: SparkSession, sf_dir: str, *strategies: str) -> DataFrame:
    return chunking.chunk(documents(spark, sf_dir), list(strategies or (STRATEGY,)))


_shared: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What several queries read, made once in a session for each state of the input tables."""
    key = (name, id(spark.sparkContext), sf_dir, stamp(spark, f"{sf_dir}/documents.parquet"), stamp(spark, f"{sf_dir}/benchmark.parquet"))
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def lists_of(spark: SparkSession, sf_dir: str) -> retrieval.Lists:
    """Dense and lexical lists of a corpus: the hybrid retrievers only read them."""
    return shared(spark, sf_dir, "lists", lambda: retrieval.Lists.of(benchmark_queries(spark, sf_dir), chunks_of(spark, sf_dir)))


def rows_of(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", "rank", "doc_id", "pos")


def scored(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", "rank", "doc_id", "pos", F.round("score", 6).alias("score"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "gold", lambda: materialize(evaluate.with_reference(benchmark_queries(spark, sf_dir), documents(spark, sf_dir)), "gold"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: the evaluation corpus."""
    return table(spark, sf_dir, "labels").select("doc_id").distinct()


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "pos", F.length("text").alias("n"), F.md5("text").alias("digest"))


# -- text and chunks --------------------------------------------------------


@query
def norm_text(spark, d):
    return documents(spark, d).select("doc_id", F.md5(fn.normalize("text")).alias("digest"), F.length(fn.normalize("text")).alias("n"))


@query
def tokenize_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(fn.tokens("text")).alias("n_tokens"), F.size(fn.distinct_tokens("text")).alias("n_distinct"))


@query
def chunk_line_merge(spark, d):
    return _digests(chunks_of(spark, d))


@query
def chunk_uids(spark, d):
    return chunks_of(spark, d).select("doc_id", "pos", "chunk_uid")


@query
def chunk_para_merge(spark, d):
    return _digests(chunks_of(spark, d, "para_nn_merge"))


@query
def chunk_global_index(spark, d):
    return chunking.global_index(chunks_of(spark, d).select("doc_id", "pos"), "doc_id", "pos").select("doc_id", "pos", "idx", fn.chunk_uid("doc_id", F.lit(STRATEGY), "idx").alias("uid"))


@query
def chunk_stats(spark, d):
    return chunking.statistics(chunks_of(spark, d))


@query
def chunk_stats_all_strategies(spark, d):
    return chunking.statistics(chunks_of(spark, d, *chunking.SPECS))


@query
def chunk_recursive_500(spark, d):
    return _digests(chunks_of(spark, d, "len_500_o50"))


@query
def chunk_recursive_1000(spark, d):
    return _digests(chunks_of(spark, d, "len_1000_o100"))


@query
def chunk_recursive_1500(spark, d):
    return _digests(chunks_of(spark, d, "len_1500_o150"))


@query
def chunk_recursive_2000(spark, d):
    return _digests(chunks_of(spark, d, "len_2000_o0"))


@query
def chunk_recursive_2000_o200(spark, d):
    return _digests(chunks_of(spark, d, "len_2000_o200"))


@query
def chunk_recursive_paragraphs(spark, d):
    return _digests(chunks_of(spark, d, "rec_nn_priority"))


@query
def chunk_recursive_legal(spark, d):
    return _digests(chunks_of(spark, d, "rec_legal_markers"))


@query
def chunk_char_nn(spark, d):
    return _digests(chunks_of(spark, d, "char_nn_only"))


@query
def citations_in_text(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] [7][x]["), (F.col("conv_id") % 5).cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", F.array_join(fn.cited_ranks(text), ",").alias("ranks"))


@query
def snippets_and_titles(spark, d):
    return documents(spark, d).select("doc_id", F.md5(fn.clipped("text", 400)).alias("snippet"), F.md5(fn.clipped("text", 800)).alias("preview"), fn.title("text").alias("title"))


@query
def legal_ids(spark, d):
    n = F.col("doc_id")
    made = F.concat((n % 9).cast("string"), (1990 + n % 30).cast("string"), F.element_at(F.array(F.lit("R"), F.lit("D"), F.lit("L"), F.lit("x")), (n % 4 + 1).cast("int")), F.lpad((n % 10000).cast("string"), 4, "0"))
    made = F.when(n % 5 == 0, F.concat(made, F.lit("R(01)"))).otherwise(made)
    return documents(spark, d).select("doc_id", made.alias("legal_id")).select("doc_id", *(c.alias(name) for name, c in fn.legal_id("legal_id").items()))


@query
def document_urls(spark, d):
    return documents(spark, d).select("doc_id", fn.document_url("https://example.org/doc/", "doc_id").alias("url"))


@query
def json_repair(spark, d):
    docs = table(spark, d, "documents")
    raw = F.concat(F.lit("```json\nNote {\"lang\": \""), "lang", F.lit("\", \"n\": ["), F.col("n_chars").cast("string"), F.lit(",], }\n```"))
    fixed = F.from_json(fn.json_object(raw), "lang string, n array<long>")
    return docs.select("doc_id", fixed["lang"].alias("lang"), fixed["n"][0].alias("n"))


# -- corpus preparation -----------------------------------------------------


@query
def label_resolve(spark, d):
    docs = documents(spark, d)
    names = docs.select(F.explode("labels").alias("label_id")).distinct().where("label_id not like '%7'").select("label_id", F.lit("en").alias("lang"), F.concat(F.lit("Name of "), "label_id").alias("name"))
    named = enrich.resolve_labels(docs, names)
    return named.select("doc_id", *(c.alias(n) for n, c in enrich.label_metadata().items()))


@query
def language_filter(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.length("text").alias("n"))


@query
def hash_sample(spark, d):
    return enrich.hash_sample(documents(spark, d).select("doc_id"), 100)


@query
def minimum_length(spark, d):
    return documents(spark, d).where(F.length("text") >= 500).select("doc_id")


@query
def manifest_semi(spark, d):
    return documents(spark, d).select("doc_id").join(manifest(spark, d), "doc_id", "left_semi")


@query
def manifest_anti(spark, d):
    return documents(spark, d).select("doc_id").join(manifest(spark, d), "doc_id", "left_anti")


@query
def scope_violations(spark, d):
    found = gold(spark, d).where("reference is not null")
    return enrich.out_of_scope(found, manifest(spark, d)).select("query_id", "reference")


@query
def input_violations(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    return enrich.violations(docs.unionAll(docs.where("doc_id % 100 = 0")))


@query
def chunk_subset_counts(spark, d):
    return enrich.subset_counts(chunks_of(spark, d), manifest(spark, d))


@query
def three_way_count(spark, d):
    docs, labels, chunks = table(spark, d, "documents"), table(spark, d, "labels"), chunks_of(spark, d).select("doc_id", "pos")
    return chunks.join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id").where("lang = 'en' and quality = 1").agg(F.count("*").alias("n"))


@query
def label_value_counts(spark, d):
    return enrich.value_counts(documents(spark, d).select(F.explode("labels").alias("label")), "label")


@query
def label_unique(spark, d):
    each = documents(spark, d).select("doc_id", F.explode_outer("labels").alias("label"))
    return each.agg(F.count("*").alias("n_rows"), F.count("label").alias("n_labels"), F.count_distinct("label").alias("n_distinct"))


@query
def group_size_two_keys(spark, d):
    return enrich.pair_counts(table(spark, d, "documents"), "lang", "source", keep_null=False, top=30)


@query
def string_lengths(spark, d):
    ids = F.col("doc_id").cast("string")
    return documents(spark, d).agg(F.count_distinct(F.length(ids)).alias("n_lengths"), F.min(F.length(ids)).alias("least"), F.max(F.length(ids)).alias("most"))


@query
def bow_counts(spark, d):
    return enrich.word_counts(documents(spark, d), fn.tokens(fn.normalize("text")), ("the", "of", "de", "la", "der"))


@query
def recent_turns(spark, d):
    return enrich.recent_turns(table(spark, d, "conversations"), 3, F.md5(fn.clipped_within("text", 120)))


@query
def history_turns(spark, d):
    return enrich.paired_turns(table(spark, d, "conversations")).select("conv_id", "turn", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"))


@query
def newest_conversations(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"))


# -- duplicates -------------------------------------------------------------


@query
def tfidf_top_terms(spark, d):
    return dedup.top_terms(dedup.representatives(documents(spark, d)), 3)


@query
def similar_pairs(spark, d):
    return pairs_of(spark, d)


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "pairs", lambda: materialize(dedup.similar_pairs(dedup.representatives(documents(spark, sf_dir))), "pairs"))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "groups", lambda: materialize(dedup.groups(documents(spark, sf_dir), pairs=pairs_of(spark, sf_dir)), "groups"))


@query
def dup_components(spark, d):
    return groups_of(spark, d)


@query
def dedup_keepers(spark, d):
    chars = table(spark, d, "documents").select("doc_id", "n_chars")
    return dedup.keepers(groups_of(spark, d).join(chars, "doc_id"), "n_chars")


@query
def dup_group_size(spark, d):
    return dedup.with_size(groups_of(spark, d)).select("doc_id", "component", "group_size")


@query
def dup_group_id(spark, d):
    return dedup.dense_group_id(groups_of(spark, d)).select("doc_id", "group_id")


@query
def dedup_stats(spark, d):
    return dedup.statistics(groups_of(spark, d), pairs_of(spark, d))


# -- retrieval --------------------------------------------------------------


@query
def bm25_terms(spark, d):
    index = search.LexicalIndex(chunks_of(spark, d))
    return index.terms_idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_top10(spark, d):
    return scored(fusion.head(lists_of(spark, d).lexical, K))


@query
def dense_text_top10(spark, d):
    return scored(fusion.head(lists_of(spark, d).dense, K))


@query
def dense_k3(spark, d):
    return scored(fusion.head(lists_of(spark, d).dense, 3))


@query
def dense_top10(spark, d):
    rows = spread(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = search.nearest(rows, asked, K, "euclidean", ("vec_id",), "vec_id")
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("distance"), F.round(1 / (1 + F.col("score")), 6).alias("similarity"))


@query
def dense_mmr(spark, d):
    return rows_of(lists_of(spark, d).base("dense_mmr_k10", K))


@query
def rrf_k60(spark, d):
    return scored(lists_of(spark, d).base("hyb_rrf_k60", K))


@query
def rrf_k30(spark, d):
    return scored(lists_of(spark, d).base("hyb_rrf_k30", K))


@query
def rrf_fetch40(spark, d):
    return scored(lists_of(spark, d).base("hyb_rrf_fetch40", K))


@query
def weighted_norm(spark, d):
    return scored(lists_of(spark, d).base("hyb_weighted_norm", K))


@query
def weighted_dense_70(spark, d):
    return scored(lists_of(spark, d).base("hyb_weighted_dense_70", K))


@query
def minmax_norm(spark, d):
    lexical = fusion.head(lists_of(spark, d).lexical, 20)
    return lexical.select("query_id", "rank", F.round(fusion.scaled(F.col("score")), 6).alias("norm"))


@query
def interleave(spark, d):
    return rows_of(lists_of(spark, d).base("hyb_interleave", K))


@query
def fill_dense_bm25(spark, d):
    return rows_of(lists_of(spark, d).base("hyb_fill_dense_then_bm25", K))


@query
def first_seen_dedupe(spark, d):
    lists = lists_of(spark, d)
    return rows_of(fusion.concatenated([fusion.head(lists.lexical, 20), fusion.head(lists.dense, 20)]))


@query
def pad_to_k(spark, d):
    lists = lists_of(spark, d)
    return rows_of(fusion.padded(fusion.head(lists.lexical, 5), [fusion.head(lists.dense, 80), fusion.head(lists.lexical, 80)], 20))


@query
def rerank_lexical(spark, d):
    lists = lists_of(spark, d)
    return scored(rerank.rerank(fusion.head(lists.lexical, POOL), lists.queries, lists.chunks, K))


@query
def neighbors_expand(spark, d):
    lists = lists_of(spark, d)
    return rows_of(rerank.with_neighbours(fusion.head(lists.lexical, 5), lists.chunks))


@query
def neighbors_rerank(spark, d):
    return rows_of(lists_of(spark, d).with_neighbours("bm25_k10"))


@query
def multiquery_union(spark, d):
    lists = lists_of(spark, d)
    variants = lists.queries.select("query_id", fn.half_split("question").alias("variants"))
    return rows_of(retrieval.multi_query(variants, lists, "bm25_k10"))


@query
def chat_threshold(spark, d):
    return lists_of(spark, d).chat("bm25_k10").select("query_id", "rank", "doc_id", "pos", "relevance")


@query
def group_sources(spark, d):
    lists = lists_of(spark, d)
    grouped = chat.grouped_sources(fusion.head(lists.lexical, 20), lists.chunks)
    return grouped.select("query_id", "doc_id", F.array_join(F.transform("sources", lambda s: s["rank"].cast("string")), ",").alias("ranks"), F.md5(F.element_at("sources", 1)["snippet"]).alias("snippet"))


@query
def citations(spark, d):
    lists = lists_of(spark, d)
    answers = lists.queries.select("query_id", F.when(F.col("query_id") % 3 == 0, "none [99]").otherwise(F.concat(F.lit("see [2] and ["), (F.col("query_id") % 7).cast("string"), F.lit("]"))).alias("answer"))
    return chat.resolve_citations(answers, fusion.head(lists.lexical, K))


@query
def prompts(spark, d):
    lists = lists_of(spark, d)
    return chat.prompts(fusion.head(lists.lexical, 3), lists.queries, lists.chunks).select("query_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


# -- evaluation -------------------------------------------------------------

#: Retrievers whose whole plan SQL can reproduce.
CHECKED = [r for r in retrieval.RETRIEVERS if "mmr" not in r]


def grid_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rankings of all checked retrievers, first hits)."""

    def make() -> tuple[DataFrame, DataFrame]:
        lists = lists_of(spark, sf_dir)
        rankings = materialize(retrieval.grid({STRATEGY: lists}, CHECKED, K), "grid")
        hits = evaluate.first_hits(rankings, gold(spark, sf_dir), lists.chunks, ("strategy", "retriever"))
        return rankings, materialize(hits, "hits")

    return shared(spark, sf_dir, "grid", make)


def strategy_lists(spark: SparkSession, sf_dir: str) -> dict[str, retrieval.Lists]:
    """Lists of all ten chunkings."""

    def make() -> dict[str, retrieval.Lists]:
        others = [s for s in chunking.SPECS if s != STRATEGY]
        made = campaign.lists_by_strategy(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), others) | {STRATEGY: lists_of(spark, sf_dir)}
        return {s: made[s] for s in chunking.SPECS}

    return shared(spark, sf_dir, "strategies", make)


def whole_grid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits of ten chunkings by twenty retrievers."""

    def make() -> DataFrame:
        lists = strategy_lists(spark, sf_dir)
        rows = materialize(retrieval.grid(lists, list(retrieval.RETRIEVERS), K), "whole-grid")
        return materialize(campaign.first_hits(rows, gold(spark, sf_dir), lists), "whole-hits")

    return shared(spark, sf_dir, "whole grid", make)


def pair_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits of the ten chosen pairs to rank 20."""

    def make() -> DataFrame:
        lists = {s: strategy_lists(spark, sf_dir)[s] for s in campaign.strategies_of(campaign.PAIRS)}
        rows = materialize(campaign.rankings(lists, campaign.PAIRS), "pair-rankings")
        return materialize(campaign.first_hits(rows, gold(spark, sf_dir), lists), "pair-hits")

    return shared(spark, sf_dir, "pair hits", make)


@query
def grid_rankings(spark, d):
    return grid_of(spark, d)[0].select("strategy", "retriever", "query_id", "rank", "doc_id", "pos")


@query
def gold_references(spark, d):
    return gold(spark, d).select("query_id", "reference")


@query
def first_hit(spark, d):
    return grid_of(spark, d)[1]


@query
def grid_summary(spark, d):
    return evaluate.summary(grid_of(spark, d)[1], "strategy", "retriever")


@query
def rank_histogram(spark, d):
    return evaluate.histogram(grid_of(spark, d)[1], K, "strategy", "retriever")


@query
def hit_rate_pivot(spark, d):
    return evaluate.pivot(evaluate.summary(grid_of(spark, d)[1], "strategy", "retriever"), "strategy", "retriever", CHECKED)


@query
def merge_summaries(spark, d):
    rows = evaluate.summary(grid_of(spark, d)[1], "strategy", "retriever")
    plain = rows.where(~F.col("retriever").endswith(retrieval.RERANKED))
    return evaluate.merged([("eval1", "plain", plain), ("eval2", "reranked", rows.join(plain, ["strategy", "retriever"], "left_anti"))])


@query
def mmr_summary(spark, d):
    """The two retrievers that SQL doesn't check."""
    lists = lists_of(spark, d)
    rankings = materialize(retrieval.grid({STRATEGY: lists}, ["dense_mmr_k10", "dense_mmr_k10_ce_r50"], K), "mmr")
    return evaluate.summary(evaluate.first_hits(rankings, gold(spark, d), lists.chunks, ("strategy", "retriever")), "strategy", "retriever")


@query
def grid_summary_all(spark, d):
    """All ten chunkings by all twenty retrievers."""
    return evaluate.summary(whole_grid_hits(spark, d), "strategy", "retriever")


@query
def hit_rate_pivot_all(spark, d):
    return evaluate.pivot(evaluate.summary(whole_grid_hits(spark, d), "strategy", "retriever"), "strategy", "retriever", list(retrieval.RETRIEVERS))


@query
def pairs_summary(spark, d):
    """The ten chosen pairs to rank 20."""
    return evaluate.summary(pair_hits(spark, d), "strategy", "retriever")


@query
def pairs_histogram(spark, d):
    return evaluate.histogram(pair_hits(spark, d), campaign.PAIR_K, "strategy", "retriever")


@query
def pairs_kept_summary(spark, d):
    """The chosen pairs on the de-duplicated corpus, for the questions whose reference is in it."""
    docs = documents(spark, d)
    left = materialize(campaign.kept(docs, QUERIES["dedup_keepers"](spark, d)), "kept")
    own = materialize(evaluate.with_reference(benchmark_queries(spark, d), left), "kept-gold")
    lists = campaign.lists_by_strategy(left, benchmark_queries(spark, d), campaign.strategies_of(campaign.PAIRS))
    rows = materialize(campaign.rankings(lists, campaign.PAIRS), "kept-rankings")
    return evaluate.summary(campaign.first_hits(rows, own.where("reference is not null"), lists), "strategy", "retriever")


@query
def pairs_neighbours_summary(spark, d):
    """The chosen pairs with the chunks around each result."""
    pairs = campaign.PAIRS
    lists = {s: strategy_lists(spark, d)[s] for s in campaign.strategies_of(pairs)}
    rows = materialize(campaign.neighbour_rankings(lists, pairs), "neighbour-rankings")
    return evaluate.summary(campaign.first_hits(rows, gold(spark, d), lists), "strategy", "retriever")


@query
def strategies_first_seen(spark, d):
    pairs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(campaign.PAIRS)], "at int, strategy string")
    return campaign.first_seen(pairs, "strategy", "at")


@query
def pairs_fingerprint(spark, d):
    return spark.range(1).select(F.sha2(F.lit(campaign.pairs_text(campaign.PAIRS)), 256).alias("fingerprint"))


@query
def stored_questions(spark, d):
    """Rewritten questions of a strategy; those of even ids are stored already."""
    queries, targets = benchmark_queries(spark, d), chunking.statistics(chunks_of(spark, d)).select("strategy", "target_words")
    stored = campaign.stored_questions(queries.where("query_id % 2 = 0"), targets)
    rows = campaign.required(campaign.stored_questions(queries, targets, stored), queries, [STRATEGY])
    return rows.select("strategy", "query_id", "enhanced_question", "target_words")


@query
def question_prompts(spark, d):
    q = benchmark_queries(spark, d)
    return q.select("query_id", F.md5(campaign.rewrite_prompt("question", F.lit(120))).alias("rewrite"), F.md5(campaign.variants_prompt("question", F.lit(120))).alias("variants"))


@query
def responses(spark, d):
    """Answers over each question's five best chunks, as records."""
    lists = lists_of(spark, d)
    inputs = campaign.model_inputs(fusion.head(lists.lexical, 5), lists.queries, lists.chunks)
    rows = campaign.responses(inputs, gold(spark, d))
    return rows.join(inputs.select("query_id", "prompt"), "query_id").select("query_id", "reference", F.size("reference_contexts").alias("n_reference"), "n_documents", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"))


@query
def accepted_snippets(spark, d):
    """The first fifty documents in seeded order whose snippet gives a question and an answer that pass."""
    made = campaign.made_questions(groundtruth.snippets(documents(spark, d)))
    return campaign.first_accepted(made, 50, F.col("supported")).select("doc_id", "turn", F.md5("question").alias("question"))


# -- gold snippets and scores -----------------------------------------------


@query
def snippet_pick(spark, d):
    return groundtruth.snippets(documents(spark, d)).select("doc_id", F.length("gold_snippet").alias("n"), F.md5("gold_snippet").alias("digest"))


@query
def snippet_all_strategies(spark, d):
    return groundtruth.in_every_chunking(documents(spark, d), list(chunking.SPECS)).select("doc_id", F.md5("gold_snippet").alias("digest"))


@query
def snippet_middle_only(spark, d):
    picked = gold(spark, d).where("reference is not null").select(F.col("reference").alias("doc_id"), "gold_snippet")
    return groundtruth.in_middle_only(picked.distinct(), chunks_of(spark, d)).select("doc_id", F.md5("gold_snippet").alias("digest"), "pos")


@query
def question_valid(spark, d):
    q = benchmark_queries(spark, d).withColumn("asked", template_question("question", 6))
    return q.select("query_id", groundtruth.question_passes("asked", "gold_snippet").alias("passes"), groundtruth.question_passes("asked", "gold_snippet", ("the document",)).alias("passes_strict"))


@query
def answer_valid(spark, d):
    return benchmark_queries(spark, d).select("query_id", groundtruth.answer_passes("question", "gold_snippet").alias("passes"))


@query
def skip_reason(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", (F.col("doc_id") % 4).cast("int").alias("n_contexts"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("answer"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("reference")
    )
    return rows.select("doc_id", scoring.skip_reason("minimal").alias("minimal"), scoring.skip_reason("full").alias("full"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select("vec_id", F.when(F.col("vec_id") % 7 != 0, at(0)).alias("m1"), F.when(F.col("vec_id") % 2 == 0, at(1)).alias("m2"), F.when(F.col("vec_id") % 11 == 0, float("nan")).otherwise(at(2)).alias("m3"), F.when(F.col("vec_id") % 13 == 0, "no_answer").alias("skip_reason"))


@query
def overall_mean(spark, d):
    return score_rows(spark, d).select("vec_id", scoring.overall_mean("m1", "m2", "m3").alias("overall_score"))


@query
def score_stats(spark, d):
    return scoring.statistics(score_rows(spark, d), ["m1", "m2", "m3"])


def _contexts(spark: SparkSession, sf_dir: str, clean: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    lists = lists_of(spark, sf_dir)
    contexts = fusion.head(lists.lexical, 5).join(lists.chunks, ["doc_id", "pos"]).select("query_id", "rank", clean("text").alias("text"))
    return contexts, benchmark_queries(spark, sf_dir).select("query_id", clean("gold_snippet").alias("reference_text"))


def _ascii(column: str) -> Column:
    """SQL engines measure edits in bytes or in characters; of ASCII both are the same."""
    return F.regexp_replace(column, r"[^\x20-\x7e]", "?")


@query
def edit_similarity_precision(spark, d):
    return scoring.context_precision(*_contexts(spark, d, _ascii))


@query
def edit_similarity_recall(spark, d):
    return scoring.context_recall(*_contexts(spark, d, _ascii))


@query
def edit_similarity_precision_whole(spark, d):
    """In characters, of whatever script."""
    return scoring.context_precision(*_contexts(spark, d, F.col))


@query
def edit_similarity_recall_whole(spark, d):
    return scoring.context_recall(*_contexts(spark, d, F.col))


# -- joins, sets and payloads -----------------------------------------------


@query
def last_row_wins(spark, d):
    return last_by_key(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query
def unknown_ids(spark, d):
    asked = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    return asked.join(documents(spark, d).select("doc_id"), "doc_id", "left_anti")


@query
def legal_subset(spark, d):
    rows = QUERIES["legal_ids"](spark, d).where("type = 'D' and code like '%5'")
    return chunking.global_index(rows.select("doc_id", "year", "code"), "year", "doc_id").select("doc_id", "year", "code", (F.col("idx") + 1).alias("rank"))


@query
def revision_counts(spark, d):
    return QUERIES["legal_ids"](spark, d).agg(F.count_if("is_revision").alias("revisions"), F.count("sector").alias("matched"), F.count("*").alias("n"))


@query
def group_size_null_keys(spark, d):
    rows = table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    return enrich.pair_counts(rows, "lang", "source", top=40)


@query
def kept_chunks(spark, d):
    return chunks_of(spark, d).join(manifest(spark, d), "doc_id", "left_semi").select("doc_id", "pos")


@query
def unused_references(spark, d):
    used = gold(spark, d).where("reference is not null").select(F.col("reference").alias("doc_id")).distinct()
    return documents(spark, d).select("doc_id").join(used, "doc_id", "left_anti")


@query
def reference_fill(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.col("source")).alias("reference"))
    truth = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("reference"))
    return scoring.with_references(rows, truth).select("id", "reference")


@query
def list_sets(spark, d):
    """Sizes of union, intersection and difference of each query's dense and lexical top 20."""
    lists = lists_of(spark, d)
    own, other = (fusion.head(x, 20).select(*fusion.KEY) for x in (lists.dense, lists.lexical))
    parts = {"both": own.intersect(other), "either": own.union(other).distinct(), "dense_only": own.subtract(other)}
    counts = [rows.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("part"), "n") for name, rows in parts.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query
def document_keys(spark, d):
    uid = F.when(F.col("pos") % 2 == 0, F.col("chunk_uid")).otherwise("")
    return chunks_of(spark, d).select("doc_id", "pos", F.md5(fn.document_key(uid, "doc_id", "text")).alias("key"))


@query
def relative_times(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", fn.relative_time("ts", now).alias("label"))


@query
def stream_tokens(spark, d):
    text = F.regexp_replace("text", "[^A-Za-z ]", "")
    token = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[{"type": "text", "text": "'), text, F.lit('"}, {"type": "text", "text": "!"}]')))
    token = token.when(F.col("turn") % 3 == 1, F.concat(F.lit("[{'type': 'text', 'text': '"), text, F.lit("'}]"))).otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", fn.block_text(token).alias("plain"))


@query
def variant_pairs(spark, d):
    half = F.floor(F.length("question") / 2).cast("int")
    first = F.substring(F.col("question"), F.lit(1), half)
    second = F.when(F.col("query_id") % 3 == 0, F.upper(first)).when(F.col("query_id") % 3 == 1, F.substring(F.col("question"), half + 1, F.length("question"))).otherwise("short")
    pair = fn.variant_pair(F.array(first, second))
    return benchmark_queries(spark, d).select("query_id", F.array_join(pair, "|").alias("pair"))


@query
def bow_counts_nfkc(spark, d):
    """Bag of words of compatibility-composed texts, most frequent first."""
    return enrich.word_counts(documents(spark, d), fn.tokens(fn.normalize(fn.nfkc(F.coalesce("text", F.lit(""))))), ("the", "of", "de", "la", "der")).orderBy(F.col("count").desc(), "term")


@query
def seeded_order(spark, d):
    return campaign.ordered(documents(spark, d).select("doc_id"), "doc_id").select("doc_id", "turn")


@query
def coerced_numbers(spark, d):
    """Numbers out of texts of which some are none: null, then -1."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("n_chars").cast("string"))
    number = fn.number(raw)
    return table(spark, d, "documents").select("doc_id", number.alias("number"), F.coalesce(number, F.lit(-1)).alias("filled"))


@query
def language_projection(spark, d):
    """Texts by language as a map; documents that have an English one, and its text."""
    docs = table(spark, d, "documents").select("doc_id", F.create_map(F.coalesce("lang", F.lit("")), F.col("text")).alias("by_lang"))
    return enrich.in_language(docs, "by_lang", "en").select("doc_id", F.length("text").alias("n"))


@query
def previews(spark, d):
    """Results with the beginning of their documents' texts, looked up by id."""
    lists = lists_of(spark, d)
    return chat.with_previews(fusion.head(lists.lexical, 3), documents(spark, d), 800).select("query_id", "rank", "doc_id", F.md5("preview").alias("preview"))


@query
def nfkc_lengths(spark, d):
    return documents(spark, d).select("doc_id", F.length(fn.normalize(fn.nfkc(F.coalesce("text", F.lit(""))))).alias("n"))


@query
def context_texts(spark, d):
    lists = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("  "), F.col("question"))).otherwise(F.array().cast("array<string>"))
    found = fn.truncated_texts(fn.reference_texts(lists, "gold_snippet"), 60)
    return benchmark_queries(spark, d).select("query_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


@query
def marked_citations(spark, d):
    lists = lists_of(spark, d)
    answers = lists.queries.select("query_id", F.concat(F.lit("see [2] and ["), (F.col("query_id") % 7).cast("string"), F.lit("]")).alias("answer"))
    return chat.mark_cited(answers, fusion.head(lists.lexical, K))


@query
def finalized_candidates(spark, d):
    lists = lists_of(spark, d)
    return rows_of(lists.finalize(lists.candidates("hyb_interleave", 50), 20))


@query
def rankings_k20(spark, d):
    return rows_of(lists_of(spark, d).run("hyb_rrf_k60_ce_r50", 20))


@query
def stored_or_live(spark, d):
    lists = lists_of(spark, d)
    stored = fusion.head(lists.dense, K).where("query_id % 2 = 0")
    return rows_of(retrieval.stored_or_live(lists.queries, stored, fusion.head(lists.lexical, K)))


@query
def rewritten_questions(spark, d):
    """Questions without their first word stand for rewritten ones."""
    lists = lists_of(spark, d)
    asked = lists.queries.select("query_id", F.regexp_replace("question", "^[^ ]+ ", "").alias("question"))
    return rows_of(retrieval.rewritten(asked, lists, "bm25_k10", K))


@query
def finished_cells(spark, d):
    cells = grid_of(spark, d)[1].groupBy(fn.cell_key("strategy", "retriever").alias("cell")).agg(F.count("*").alias("n"))
    n = benchmark_queries(spark, d).agg(F.count("*").alias("expected"))
    return cells.crossJoin(F.broadcast(n)).select("cell", "n", (F.col("n") == F.col("expected")).alias("done"))


@query
def default_chunks(spark, d):
    return _digests(chunking.chunk(documents(spark, d), [chunking.DEFAULT]))
