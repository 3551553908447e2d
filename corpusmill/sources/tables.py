"""Adapters from the given tables to the engine's relations, and JSON/CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a benchmark item that make up its question.
QUESTION_WORDS = 12

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))])
QUERY = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "question", "reference", "gold_snippet")] + [T.StructField("source_len_chars", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, column: str) -> DataFrame:
    """A small table in one file is read by one task; deal its rows out before expensive expressions."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, column) if df.rdd.getNumPartitions() < n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, labels (language and source)."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", "text", F.array("lang", "source").alias("labels")), "doc_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question (the first words of an item), gold_snippet (the whole item)."""
    items = table(spark, sf_dir, "benchmark")
    words = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, QUESTION_WORDS)
    return items.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"), F.col("text").alias("gold_snippet"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. limit: the first rows by key."""
    rows = spark.read.schema(schema).json(path).where(" or ".join(f"`{c}` is not null" for c in schema.names))
    return rows if limit is None else rows.orderBy(key or schema.names[0]).limit(limit)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines (.jsonl), or one JSON document (.json): an array of items or an object that has them under ``items``."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", T.ArrayType(schema))
    nested = F.from_json("value", T.StructType([T.StructField("items", T.ArrayType(schema))]))
    item = F.when(F.ltrim("value").startswith("["), items).otherwise(nested["items"])
    return whole.select(F.explode(item).alias("item")).select("item.*")


def read_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """label_id, lang, name of a JSON object id -> language -> name."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, map<string, string>>")
    by_id = whole.select(F.explode(entries).alias("label_id", "names"))
    return by_id.select("label_id", F.explode("names").alias("lang", "name"))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one latest in order; of several latest the one whose other values are largest."""
    values = [c for c in rows.columns if c not in (key, order)]
    row = F.max_by(F.struct(*values), F.struct(order, *values)) if values else None
    if row is None:
        return rows.groupBy(key).agg(F.max(order).alias(order)).select(*rows.columns)
    latest = rows.groupBy(key).agg(F.max(order).alias(order), row.alias("_row"))
    return latest.select(key, order, "_row.*").select(*rows.columns)


def ground_truth(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """query_id, question, reference, gold_snippet of a ground-truth file of JSON lines."""
    rows = read_jsonl(spark, path, QUERY, "id", limit)
    return rows.select(F.col("id").alias("query_id"), "question", "reference", "gold_snippet")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by strategy, so that a reader of one strategy scans no other."""
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(path)


def read_chunks(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("strategy") == strategy)
