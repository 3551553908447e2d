"""Reranking, relevance threshold and neighbour expansion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.fusion import KEY, concatenated
from corpusmill.operators.models import coverage
from corpusmill.operators.search import fetched

Scorer = Callable[[str, str], Column]
OFFSETS = (-2, -1, 1, 2)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int | None = None, scorer: Scorer = coverage) -> DataFrame:
    """Candidates by the scorer's value (question, passage), ties by their former rank. Candidates must be distinct."""
    named = candidates.select(*KEY, F.col("rank").alias("former"))
    scored = (
        named.join(queries.select("query_id", "question"), "query_id")
        .join(fetched(named, chunks.select("doc_id", "pos", "text")), ["doc_id", "pos"])
        .withColumn("score", F.round(scorer("question", "text"), 8))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "former", "doc_id", "pos"))
    out = scored.withColumn("rank", rank).select(*KEY, "rank", "score")
    return out if k is None else out.where(F.col("rank") <= k)


def relevant(rows: DataFrame, least: float = 0.3, k: int | None = None) -> DataFrame:
    """Rows whose min-max scaled score within the query is ``least`` or more; equal scores are all 1. Unscored rows go."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0), 4)
    kept = rows.where(F.col("score").isNotNull()).withColumn("relevance", scaled).where(F.col("relevance") >= least)
    rank = F.row_number().over(w.orderBy("rank"))
    kept = kept.withColumn("rank", rank)
    return kept if k is None else kept.where(F.col("rank") <= k)


def with_neighbours(rows: DataFrame, chunks: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Each row, then the chunks around it in its document in the order of offsets; each chunk at its first place."""
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(o).alias("offset")) for i, o in enumerate((0, *offsets))))
    near = rows.select("query_id", "doc_id", "rank", F.col("pos").alias("at"), F.explode(steps).alias("s"))
    near = near.select("query_id", "doc_id", (F.col("at") + F.col("s.offset")).alias("pos"), (F.col("rank") * (len(offsets) + 1) + F.col("s.step")).alias("rank"))
    there = near.join(chunks.select("doc_id", "pos"), ["doc_id", "pos"])
    return concatenated([there])
