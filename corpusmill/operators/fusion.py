"""Fusion of ranked lists. Input and output: query_id, doc_id, pos, rank, score; ties have a total order.

Lists are inputs, never recomputed: all hybrid retrievers read one dense and one
lexical list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("query_id", "doc_id", "pos")
DIGITS = 8


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "doc_id", "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(*KEY, "rank", "score")


def head(rows: DataFrame, k: int) -> DataFrame:
    return rows.where(F.col("rank") <= k)


def first_seen(lists: list[tuple[DataFrame, Column]], k: int | None = None) -> DataFrame:
    """Lists one after another, each row at its first occurrence. Each list comes with its order key, which grows by list."""
    rows = reduce(DataFrame.unionAll, (rows.select(*KEY, key.cast("long").alias("seen")) for rows, key in lists))
    firsts = rows.groupBy(*KEY).agg(F.min("seen").alias("seen")).withColumn("score", -F.col("seen").cast("double"))
    return _ranked(firsts, k or 1 << 30, F.col("seen"))


def concatenated(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """first_seen() of whole lists in turn."""
    return first_seen([(rows, F.col("rank") + F.lit(i << 32)) for i, rows in enumerate(lists)], k)


def reciprocal_rank(dense: DataFrame, lexical: DataFrame, k: int, constant: int = 60, fetch: int = 20) -> DataFrame:
    """Sum of 1 / (constant + rank); ties by first occurrence, dense list first."""
    fetch = max(fetch, k)
    both = head(dense, fetch).select(*KEY, "rank", F.lit(0).alias("list")).unionAll(head(lexical, fetch).select(*KEY, "rank", F.lit(1).alias("list")))
    summed = both.groupBy(*KEY).agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), DIGITS).alias("score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("seen")
    )
    return _ranked(summed, k, F.col("score").desc(), F.col("seen"))


def scaled(value: Column, partition: str = "query_id") -> Column:
    """Min-max over a query's positive values: the least positive is 0, a single one is 1, others are 0."""
    w = Window.partitionBy(partition)
    positive = F.when(value > 0, value)
    low, high = F.min(positive).over(w), F.max(positive).over(w)
    return F.when(value <= 0, 0.0).when(high <= low, 1.0).otherwise((value - low) / (high - low))


def weighted(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float = 0.5, fetch: int = 20) -> DataFrame:
    """Weighted sum of both lists' scaled scores; a dense distance d counts as 1 / (1 + d)."""
    fetch = max(fetch, k)
    d = head(dense, fetch).select(*KEY, F.col("rank").alias("dense_rank"), (1 / (1 + F.col("score"))).alias("d"))
    b = head(lexical, fetch).select(*KEY, F.col("rank").alias("lexical_rank"), F.col("score").alias("b"))
    both = d.join(b, list(KEY), "full_outer").withColumns({"d": F.coalesce("d", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))})
    score = F.round(dense_weight * scaled(F.col("d")) + (1 - dense_weight) * scaled(F.col("b")), DIGITS)
    return _ranked(both.withColumn("score", score), k, F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last())


def interleaved(dense: DataFrame, lexical: DataFrame, k: int, fetch: int = 20) -> DataFrame:
    """Dense, lexical, dense, ... each row once."""
    fetch = max(fetch, k)
    return first_seen([(head(dense, fetch), 2 * (F.col("rank") - 1)), (head(lexical, fetch), 2 * (F.col("rank") - 1) + 1)], k)


def filled(dense: DataFrame, lexical: DataFrame, k: int, fetch: int = 20) -> DataFrame:
    """A first block of the dense list (half of k, 5 at least), then the lexical list, then the dense one."""
    fetch = max(fetch, k)
    return concatenated([head(dense, max(5, k // 2)), head(lexical, fetch), head(dense, fetch)], k)


def padded(rows: DataFrame, pools: list[DataFrame], k: int) -> DataFrame:
    """rows, then what the pools have in their order, up to k."""
    return concatenated([rows, *pools], k)
