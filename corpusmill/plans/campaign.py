"""Evaluations of chosen pairs of chunking and retriever, on a whole or a de-duplicated corpus, and what follows from their rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import cell_key, clipped, half_split
from corpusmill.operators import chunking, evaluate, groundtruth
from corpusmill.operators.models import extractive_answer, template_question
from corpusmill.operators.rerank import OFFSETS
from corpusmill.plans.chat import source_block
from corpusmill.plans.retrieval import RERANKED, Corpus, Lists, cells, is_reranked, multi_query

#: The ten pairs that are evaluated to rank 20. Fixed values.
PAIRS = (
    ("len_1000_o100", "hyb_rrf_k60_ce_r50"),
    ("len_1000_o100", "hyb_rrf_k30_ce_r50"),
    ("len_1000_o100", "hyb_rrf_fetch40_ce_r50"),
    ("len_1000_o100", "hyb_weighted_norm_ce_r50"),
    ("len_1000_o100", "hyb_interleave_ce_r50"),
    ("len_1500_o150", "hyb_rrf_k60_ce_r50"),
    ("len_1500_o150", "hyb_rrf_k30_ce_r50"),
    ("len_500_o50", "hyb_fill_dense_then_bm25_ce_r50"),
    ("rec_nn_priority", "hyb_fill_dense_then_bm25_ce_r50"),
    ("len_2000_o200", "hyb_interleave"),
)
PAIR_K = 20
Pairs = Iterable[tuple[str, str]]


def strategies_of(pairs: Pairs) -> list[str]:
    """Distinct strategies in the order of their first occurrence."""
    return list(dict.fromkeys(strategy for strategy, _ in pairs))


def first_seen(pairs: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with their place (from 0) by first occurrence; pairs: value, order."""
    firsts = pairs.groupBy(value).agg(F.min(order).alias("_first"))
    return chunking.global_index(firsts, "_first", value).select(F.col("idx").alias("place"), value)


def with_reranker(pairs: Pairs) -> list[tuple[str, str]]:
    """The pairs of evaluations that always rerank."""
    return [(s, r if is_reranked(r) else r + RERANKED) for s, r in pairs]


def pairs_text(pairs: Pairs) -> str:
    """The pairs as lines; sha256 of it is their fingerprint."""
    return "\n".join(f"{s}::{r}" for s, r in pairs)


def pairs_fingerprint(spark: SparkSession, pairs: Pairs) -> str:
    return spark.range(1).select(F.sha2(F.lit(pairs_text(pairs)), 256).alias("f")).first().f


def by_strategy(pairs: Pairs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for strategy, retriever in pairs:
        out.setdefault(strategy, []).append(retriever)
    return out


def lists_by_strategy(docs: DataFrame, queries: DataFrame, strategies: Iterable[str]) -> dict[str, Lists]:
    """Lists of every strategy's chunks."""
    return {s: Lists(queries, Corpus(chunking.chunk(docs, [s]))) for s in strategies}


def kept(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The de-duplicated corpus: documents that de-duplication keeps."""
    return docs.join(keepers.select("doc_id"), "doc_id", "left_semi")


def rankings(lists: dict[str, Lists], pairs: Pairs, k: int = PAIR_K, strict: bool = False) -> DataFrame:
    """strategy, retriever, query_id, doc_id, pos, rank, score of each pair."""
    return cells({s: (lists[s], names) for s, names in by_strategy(pairs).items()}, k, strict=strict)


def neighbour_rankings(lists: dict[str, Lists], pairs: Pairs, k: int = PAIR_K, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """rankings() of pools with the chunks around them."""
    rows = (lists[s].with_neighbours(r, k, offsets=offsets).select(F.lit(s).alias("strategy"), F.lit(r).alias("retriever"), "query_id", "doc_id", "pos", "rank", "score") for s, r in with_reranker(pairs))
    return reduce(DataFrame.unionAll, rows)


def question_rankings(lists: dict[str, Lists], pairs: Pairs, questions: DataFrame, k: int = PAIR_K) -> DataFrame:
    """rankings() of stored questions (strategy, query_id, enhanced_question)."""
    asked = {s: own.asked(questions.where(F.col("strategy") == s).select("query_id", F.col("enhanced_question").alias("question"))) for s, own in lists.items()}
    return rankings(asked, with_reranker(pairs), k)


def variant_rankings(lists: dict[str, Lists], pairs: Pairs, questions: DataFrame, k: int = PAIR_K) -> DataFrame:
    """Rankings of the union of a stored question's (strategy, query_id, enhanced_question, variants) and its variants' pools."""
    out = None
    for s, r in with_reranker(pairs):
        own = questions.where(F.col("strategy") == s)
        asked = lists[s].asked(own.select("query_id", F.col("enhanced_question").alias("question")))
        rows = multi_query(own.select("query_id", "variants"), asked, r, k).select(F.lit(s).alias("strategy"), F.lit(r).alias("retriever"), "query_id", "doc_id", "pos", "rank", "score")
        out = rows if out is None else out.unionAll(rows)
    return out


def first_hits(rows: DataFrame, gold: DataFrame, lists: dict[str, Lists]) -> DataFrame:
    """strategy, retriever, query_id, first_hit."""
    parts = (evaluate.first_hits(rows.where(F.col("strategy") == s), gold, own.chunks, ("strategy", "retriever")) for s, own in lists.items())
    return reduce(DataFrame.unionAll, parts)


# -- stored questions -------------------------------------------------------


#: Prompts for a language model: words, question.
REWRITE = (
    "Write the question below as one formal question of about %s words, in the terms that the documents themselves would use. "
    'Keep what it asks for, add no facts and give no answer. Answer with a JSON object {"enhanced_question": "..."} alone.\n\nQuestion: %s'
)
VARIANTS = (
    "Word the question below in two other ways of about %s words each, with other terms, another order or another emphasis, but the same fact in mind. "
    'Add no facts. Answer with a JSON object {"variants": ["...", "..."]} alone.\n\nQuestion: %s'
)


def _prompt(template: str, question: str | Column, words: str | Column) -> Column:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.format_string(template, as_col(words).cast("string"), as_col(question))


def rewrite_prompt(question: str | Column, words: str | Column) -> Column:
    """Asks for a longer, formal question, as a JSON object with enhanced_question."""
    return _prompt(REWRITE, question, words)


def variants_prompt(question: str | Column, words: str | Column) -> Column:
    """Asks for two other wordings, as a JSON object with variants."""
    return _prompt(VARIANTS, question, words)


def default_rewrite(question: Column, words: Column) -> Column:
    """Stands in for a language model: the question in a formal frame."""
    return F.concat(F.lit("According to the provisions that apply, "), F.lower(F.substring(question, 1, 1)), F.substring(question, F.lit(2), F.length(question)))


def stored_questions(
    queries: DataFrame, targets: DataFrame, stored: DataFrame | None = None, rewrite: Callable[[Column, Column], Column] = default_rewrite, variants: Callable[[Column], Column] = half_split
) -> DataFrame:
    """strategy, query_id, original_question, enhanced_question, target_words, variants: one row for each strategy and question.

    targets: strategy, target_words. Rows that are stored stay as they are; only missing ones are made.
    """
    n = F.broadcast(targets.select("strategy", "target_words"))  # a row for each strategy, ten at most
    wanted = queries.select("query_id", F.col("question").alias("original_question")).crossJoin(n)
    if stored is not None:
        wanted = wanted.join(stored.select("strategy", "query_id"), ["strategy", "query_id"], "left_anti")
    made = wanted.withColumn("enhanced_question", rewrite(F.col("original_question"), F.col("target_words")))
    made = made.withColumn("variants", variants(F.col("enhanced_question"))).select("strategy", "query_id", "original_question", "enhanced_question", "target_words", "variants")
    return made if stored is None else stored.select(*made.columns).unionAll(made)


def required(questions: DataFrame, queries: DataFrame, strategies: Iterable[str]) -> DataFrame:
    """questions; an error if a strategy lacks one of the queries."""
    n = queries.count()
    have = {r.strategy: r["count"] for r in questions.join(queries.select("query_id"), "query_id", "left_semi").select("strategy", "query_id").distinct().groupBy("strategy").count().collect()}
    if missing := [f"{s} ({n - have.get(s, 0)})" for s in strategies if have.get(s, 0) < n]:
        raise ValueError(f"questions are missing: {', '.join(missing)}")
    return questions


# -- gold questions ---------------------------------------------------------


def made_questions(picked: DataFrame, question: Callable[[Column], Column] = template_question, answer: Callable[[Column], Column] = lambda s: F.substring(s, 1, 400)) -> DataFrame:
    """picked (doc_id, gold_snippet) with question and answer of the slots, and supported: whether both pass the rules."""
    rows = picked.withColumn("question", question(F.col("gold_snippet"))).withColumn("answer", answer(F.col("gold_snippet")))
    return rows.withColumn("supported", groundtruth.question_passes("question", "gold_snippet") & groundtruth.answer_passes("answer", "gold_snippet"))


# -- answers ----------------------------------------------------------------


def model_inputs(rows: DataFrame, queries: DataFrame, chunks: DataFrame, chars: int = 2000) -> DataFrame:
    """query_id, question, prompt, contexts, documents: what a generator is given for each query, to be stored before it runs.

    rows: query_id, doc_id, pos, rank. documents are (rank, doc_id, pos, text) in order.
    """
    found = rows.join(chunks.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    document = F.struct("rank", "doc_id", "pos", "text")
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(document)).alias("documents"))
    blocks = F.transform("documents", lambda d: source_block(d["rank"], d["doc_id"], clipped(d["text"], chars, "\n[truncated]")))
    prompt = F.concat(F.lit("Answer from the numbered sources alone and cite them as [n].\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), "question")
    return queries.select("query_id", "question").join(lists, "query_id").select("query_id", "question", prompt.alias("prompt"), F.transform("documents", lambda d: d["text"]).alias("contexts"), "documents")


def responses(
    inputs: DataFrame, gold: DataFrame, generate: Callable[[Column, Column], Column] = extractive_answer, model: str = "extractive", source: str | Column = "live", done: DataFrame | None = None
) -> DataFrame:
    """A record for each query: its question, gold columns, documents and a generated answer. Queries in ``done`` are left out.

    gold: query_id, reference, gold_snippet. The default generator takes the first document's first sentence.
    """
    rows = inputs if done is None else inputs.join(done.select("query_id"), "query_id", "left_anti")
    rows = rows.join(gold.select("query_id", "reference", "gold_snippet"), "query_id", "left")
    snippet = F.trim(F.coalesce("gold_snippet", F.lit("")))
    return rows.select(
        "query_id", "question", "reference", "gold_snippet",
        F.when(snippet != "", F.array(snippet)).otherwise(F.array().cast("array<string>")).alias("reference_contexts"),
        "documents", F.trim(generate(F.col("question"), F.get("contexts", F.lit(0)))).alias("answer"),
        F.lit(model).alias("generator"), F.size("documents").alias("n_documents"), (F.lit(source) if isinstance(source, str) else source).alias("retrieval_source"),
    )


def score_table(rows: DataFrame, columns: list[str], path: str) -> None:
    """Scores as CSV with these columns in this order; others are left out, missing ones are empty."""
    have = set(rows.columns)
    rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def cell_counts(hits: DataFrame) -> DataFrame:
    """cell, n: results so far by cell."""
    return hits.groupBy(cell_key("strategy", "retriever").alias("cell")).agg(F.count("*").alias("n"))


def ordered(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with ``turn``, their place (from 1) in a seeded order: attempts come in this order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return chunking.global_index(rows.withColumn("_order", order), "_order", key).withColumn("turn", F.col("idx") + 1).drop("_order", "idx")


def first_accepted(candidates: DataFrame, n: int, accepted: Column, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The first n accepted rows in the seeded order, with their turn: what a loop over attempts that stops at n would give."""
    turns = ordered(candidates, key, seed).where(accepted)
    return turns.orderBy("turn").limit(n)
