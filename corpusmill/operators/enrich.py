"""Label resolution, manifests, subsets and profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_labels(docs: DataFrame, names: DataFrame, lang: str = "en", key: str = "doc_id") -> DataFrame:
    """docs (key, labels) with ``labels_named``, in order; a label's name in ``lang``, else in English, else its id.

    names: label_id, lang, name.
    """
    best = names.where(F.col("lang").isin(lang, "en")).groupBy("label_id").agg(
        F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("name"))), F.max("name")).alias("name")
    )
    each = docs.select(key, F.posexplode(F.coalesce("labels", F.array())).alias("at", "label_id"))
    named = each.join(best, "label_id", "left").select(key, F.struct("at", F.coalesce("name", "label_id").alias("name")).alias("x"))
    lists = named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["name"]).alias("labels_named"))
    return docs.join(lists, key, "left").withColumn("labels_named", F.coalesce("labels_named", F.array().cast("array<string>")))


def in_language(docs: DataFrame, texts: str, lang: str) -> DataFrame:
    """Rows whose map of texts by language has ``lang``, with its text."""
    return docs.where(F.map_contains_key(texts, lang)).withColumn("text", F.element_at(texts, lang))


def scalar_columns(rows: DataFrame) -> DataFrame:
    """Without arrays, maps and structs, for stores that keep scalar metadata alone."""
    return rows.select(*(f"`{c}`" for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))))


def label_metadata(labels: str = "labels", names: str = "labels_named") -> dict[str, Column]:
    return {"label_ids": F.array_join(labels, ","), "categories": F.array_join(names, ", ")}


def hash_sample(rows: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows without replacement in a seeded order by md5; the same on any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def violations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows without id, rows without text, and ids that occur more than once."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    counts = docs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"))
    return counts.agg(
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("missing_id"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_text"),
        F.count_if(~blank & (F.col("n") > 1)).alias("duplicate_ids"),
    )


def out_of_scope(queries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Queries whose reference isn't among the manifest's doc_id."""
    return queries.join(manifest.select(F.col("doc_id").alias("reference")), "reference", "left_anti")


def subset_counts(chunks: DataFrame, manifest: DataFrame, by: str = "strategy") -> DataFrame:
    """Chunks of documents in and not in the manifest, by strategy."""
    marked = chunks.join(manifest.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    return marked.groupBy(by).agg(F.count("kept").alias("kept"), F.count_if(F.col("kept").isNull()).alias("dropped"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def pair_counts(rows: DataFrame, a: str, b: str, keep_null: bool = True, top: int | None = None) -> DataFrame:
    """Rows for each pair of values; the largest ``top`` pairs, ties by the values."""
    rows = rows if keep_null else rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = rows.groupBy(a, b).agg(F.count("*").alias("count"))
    return counts if top is None else counts.orderBy(F.col("count").desc(), a, b).limit(top)


def word_counts(docs: DataFrame, words: Column, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """term, count, n_docs. Counting within a document first keeps the shuffle to distinct pairs."""
    each = docs.select("doc_id", F.explode(words).alias("term"))
    if stop_words:
        each = each.where(~F.col("term").isin(*stop_words))
    pairs = each.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return pairs.groupBy("term").agg(F.sum("n").alias("count"), F.count("*").alias("n_docs"))


def recent_turns(turns: DataFrame, n: int, text: Column) -> DataFrame:
    """The last n turns of each conversation with their text."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), "role", "text"))
    return turns.withColumn("_rank", rank).where(F.col("_rank") <= n).select("conv_id", "turn", "role", text.alias("text"))


def paired_turns(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    after = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("assistant", F.lead("text").over(w))
    return after.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), "assistant")
