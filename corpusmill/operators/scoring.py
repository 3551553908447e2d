"""Scores of answers: lexical metrics, row means, summary statistics, reasons to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize


def metric(value: str | Column) -> Column:
    """A double; null where it is none or not a number."""
    x = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return F.when(~F.isnan(x), x)


def overall_mean(*metrics: str) -> Column:
    """Mean of the metrics that there are, to 6 digits; null if there are none."""
    present = F.array_compact(F.array(*map(metric, metrics)))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, F.round(total / F.size(present), 6))


def statistics(scores: DataFrame, metrics: list[str], skip: str = "skip_reason") -> DataFrame:
    """metric, mean, stdev (0 of one value, null of none), n of the rows that weren't skipped."""
    rows = scores.where(F.col(skip).isNull()) if skip in scores.columns else scores
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), metric(m).alias("value")) for m in metrics))).alias("x")).select("x.*")
    stats = long.groupBy("metric").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.when(F.count("value") == 1, 0.0).otherwise(F.round(F.stddev_samp("value"), 6)).alias("stdev"),
        F.count("value").alias("n"),
    )
    return stats


def skip_reason(mode: str, contexts: str = "n_contexts", answer: str = "answer", reference: str = "reference") -> Column:
    """Why a row can't be scored, or null. ``full`` also needs a reference."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(F.coalesce(contexts, F.lit(0)) == 0, "no_contexts").when(blank(answer), "no_answer")
    return reason.when(blank(reference), "no_reference") if mode == "full" else reason


def edit_similarity(a: str | Column, b: str | Column) -> Column:
    """1 - Levenshtein distance / the longer length, of normalised texts; two empty texts are equal."""
    x, y = normalize(a), normalize(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def context_precision(contexts: DataFrame, references: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, context_precision: average precision over ranks of contexts (query_id, rank, text) that are similar to a reference (query_id, reference_text)."""
    near = contexts.join(references, "query_id", "left").groupBy("query_id", "rank").agg(F.max(F.coalesce(edit_similarity("text", "reference_text"), F.lit(0.0))).alias("best"))
    lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", (F.col("best") >= threshold).cast("int").alias("hit")))).alias("list"))
    hits = F.transform("list", lambda x: x["hit"])
    total = F.aggregate(hits, F.lit(0), lambda a, x: a + x)
    at = F.transform(hits, lambda x, i: x * F.aggregate(F.slice(hits, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y) / (i + 1))
    return lists.select("query_id", F.round(F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / (total + 1e-10), 6).alias("context_precision"))


def context_recall(contexts: DataFrame, references: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, context_recall: the share of references that a context is similar to."""
    near = references.join(contexts, "query_id", "left").groupBy("query_id", "reference_text").agg(F.max(F.coalesce(edit_similarity("text", "reference_text"), F.lit(0.0))).alias("best"))
    return near.groupBy("query_id").agg(F.round(F.avg((F.col("best") >= threshold).cast("double")), 6).alias("context_recall"))


def with_references(rows: DataFrame, truth: DataFrame, key: str = "id", column: str = "reference") -> DataFrame:
    """rows with a blank ``column`` filled from the truth's."""
    named = truth.select(key, F.col(column).alias("_other"))
    return rows.join(named, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), "_other")).drop("_other")
