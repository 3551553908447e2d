"""First hits, hit rate, reciprocal rank, rank histograms, pivots and merged summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize
from corpusmill.operators.search import fetched

#: MB of snippets that a task searches for at once.
SNIPPET_MB = 16


def contains(text: str | Column, snippet: str | Column) -> Column:
    """Whether the normalised text has the normalised snippet; an empty snippet is nowhere."""
    wanted = normalize(snippet)
    return (wanted != "") & F.contains(normalize(text), wanted)


def first_hits(rankings: DataFrame, queries: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, query_id, first_hit: the least rank of a chunk of the reference document that has the gold snippet; null for none.

    rankings: by, query_id, doc_id, pos, rank. queries: query_id, reference, gold_snippet.
    """
    gold = queries.select("query_id", F.col("reference").alias("doc_id"), "gold_snippet")
    texts = fetched(rankings, chunks.select("doc_id", "pos", "text"))
    hits = rankings.join(gold, ["query_id", "doc_id"]).join(texts, ["doc_id", "pos"]).where(contains("text", "gold_snippet"))
    ranks = hits.groupBy(*by, "query_id").agg(F.min("rank").alias("first_hit"))
    asked = queries.select("query_id")
    if by:
        asked = asked.crossJoin(F.broadcast(rankings.select(*by).distinct()))  # the cells of the grid, a few hundred
    return asked.join(ranks, [*by, "query_id"], "left").select(*by, "query_id", "first_hit")


def summary(hits: DataFrame, *by: str) -> DataFrame:
    """hit_rate, mrr, n for each cell; misses count 0."""
    return hits.groupBy(*by).agg(
        F.round(F.count("first_hit") / F.count("*"), 4).alias("hit_rate"),
        F.round(F.sum(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))) / F.count("*"), 4).alias("mrr"),
        F.count("*").alias("n"),
    )


def histogram(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """Counts by rank 1 to k and miss, zeros too; ranks beyond k are in miss."""
    bucket = F.when(F.col("first_hit") <= k, F.col("first_hit").cast("string")).otherwise("miss")
    counts = hits.groupBy(*by, bucket.alias("rank_bucket")).agg(F.count("*").alias("count"))
    names = F.concat(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda x: x.cast("string")), F.array(F.lit("miss")))
    spine = hits.select(*by).distinct() if by else hits.sparkSession.range(1).select()
    spine = spine.select(*by, F.explode(names).alias("rank_bucket"))
    return spine.join(counts, [*by, "rank_bucket"], "left").fillna(0, ["count"])


def pivot(summaries: DataFrame, row: str, column: str, names: list[str], value: str = "hit_rate") -> DataFrame:
    """One row for each ``row``, one column for each name in the given order; missing cells are null."""
    return summaries.groupBy(row).pivot(column, names).agg(F.first(value))


def merged(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Summaries below each other with their eval_id and eval_label in front."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("eval_id"), F.lit(label).alias("eval_label"), "*") for i, label, df in parts))


def containing(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """query_id, doc_id where the normalised text contains the normalised snippet (query_id, gold_snippet).

    An automaton over a bounded block of snippets reads each text once, whatever the number of snippets.
    """
    wanted = snippets.select("query_id", normalize("gold_snippet").alias("wanted")).where("wanted <> ''")
    size = wanted.agg(F.sum(F.length("wanted"))).first()[0] or 0
    blocks = int(size / (SNIPPET_MB * 1e6)) + 1
    texts = docs.select("doc_id", normalize("text").alias("text")).where("text is not null")
    dtypes = dict(wanted.dtypes) | dict(texts.dtypes)
    schema = f"query_id {dtypes['query_id']}, doc_id {dtypes['doc_id']}"
    out = None
    for i in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r.query_id, r.wanted) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kinds=(wanted.schema["query_id"], texts.schema["doc_id"])) -> Iterator[pa.RecordBatch]:
            words: dict[str, list] = {}
            for query_id, snippet in shared.value:
                words.setdefault(snippet, []).append(query_id)
            automaton = ahocorasick.Automaton()
            for snippet, ids in words.items():
                automaton.add_word(snippet, ids)
            if not words:
                return
            automaton.make_automaton()
            for batch in batches:
                found = [(q, doc) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for q in {q for _, ids in automaton.iter(text) for q in ids}]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["query_id", "doc_id"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def with_reference(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """queries with ``reference``: the smallest doc_id that contains the gold snippet, else null."""
    found = containing(docs, queries).groupBy("query_id").agg(F.min("doc_id").alias("reference"))
    return queries.join(found, "query_id", "left")
