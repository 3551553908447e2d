"""Chat payloads: grouped sources, prompts, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import cited_ranks, clipped


def with_previews(ranking: DataFrame, docs: DataFrame, chars: int = 800) -> DataFrame:
    """ranking with ``preview``, the beginning of the document's text; null where there is no such document."""
    looked = docs.join(ranking.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", clipped("text", chars).alias("preview"))
    return ranking.join(looked, "doc_id", "left")


def grouped_sources(ranking: DataFrame, chunks: DataFrame, snippet: int = 400) -> DataFrame:
    """query_id, doc_id, sources (rank, pos, score, snippet in order of rank), place (by document, one without an id last): a row for each document."""
    rows = ranking.join(chunks.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    source = F.struct("rank", "pos", "score", clipped("text", snippet).alias("snippet"))
    groups = rows.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == "", "doc_id")))


def source_block(rank: str | Column, doc_id: str | Column, text: str | Column) -> Column:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("["), as_col(rank).cast("string"), F.lit("] Document "), as_col(doc_id).cast("string"), F.lit("\n"), as_col(text))


def prompts(ranking: DataFrame, queries: DataFrame, chunks: DataFrame, chars: int = 2000) -> DataFrame:
    """query_id, prompt: the ranked passages, numbered, and the question."""
    rows = ranking.join(chunks.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    block = F.struct("rank", source_block("rank", "doc_id", clipped("text", chars, "\n[truncated]")).alias("block"))
    blocks = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return queries.join(blocks, "query_id", "left").select(
        "query_id", F.concat(F.lit("Answer from the numbered sources alone and cite them as [n].\n\n"), F.coalesce(body, F.lit("")), F.lit("\n\nQuestion: "), "question").alias("prompt")
    )


def resolve_citations(answers: DataFrame, ranking: DataFrame) -> DataFrame:
    """query_id, rank, doc_id, pos of the ranks that an answer cites; of all where it cites none that exists.

    answers: query_id, answer. ranking: query_id, rank, doc_id, pos.
    """
    rows = ranking.select("query_id", "rank", "doc_id", "pos").join(answers.select("query_id", cited_ranks("answer").alias("cited")), "query_id")
    marked = rows.withColumn("used", F.coalesce(F.array_contains("cited", F.col("rank")), F.lit(False)))
    some = marked.groupBy("query_id").agg(F.max("used").alias("some"))
    return marked.join(some, "query_id").where("used or not some").select("query_id", "rank", "doc_id", "pos")


def mark_cited(answers: DataFrame, ranking: DataFrame) -> DataFrame:
    """ranking (query_id, rank, doc_id, pos) with ``cited``: whether the answer names the rank."""
    rows = ranking.select("query_id", "rank", "doc_id", "pos").join(answers.select("query_id", cited_ranks("answer").alias("_cited")), "query_id", "left")
    return rows.withColumn("cited", F.coalesce(F.array_contains("_cited", F.col("rank")), F.lit(False))).drop("_cited")
