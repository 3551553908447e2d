"""Stored vectors, candidates, manifests and results that a later run opens, checks and continues.

Each store is a folder of Parquet tables, partitioned by what a reader selects, beside one JSON row of
metadata where a reader must know how it was made. Fingerprints are sums over rows, so they
depend on no order and need no driver memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.models import Embedder, HashingEmbedder, embed

#: What must agree before stored candidates are used, and what must if it is given.
AGREE = ("version", "eval_id", "ground_truth", "ground_truth_sha256", "manifest", "manifest_sha256", "pairs_fingerprint", "limit_queries", "final_k", "candidate_k")
AGREE_IF_GIVEN = ("neighbor_offsets", "multiquery_candidate_k")
VERSION = 1


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None where there is none or nothing was written to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """A digest of a table's rows, repeated ones too, in any order: their number and the sum of two hashes of each."""
    columns = columns or tuple(rows.columns)
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (0, 1)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("f")).first().f


# -- metadata ---------------------------------------------------------------


def write_meta(spark: SparkSession, path: str, meta: dict[str, object]) -> None:
    """One JSON row; values are stored as text."""
    rows = [(k, None if v is None else str(v)) for k, v in meta.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> dict[str, str | None] | None:
    """What write_meta wrote; None where there is nothing."""
    try:
        return {r.name: r.value for r in spark.read.schema("name string, value string").json(path).collect()}
    except AnalysisException:
        return None


def differences(stored: dict[str, str | None] | None, current: dict[str, object], agree: tuple[str, ...] = AGREE, if_given: tuple[str, ...] = AGREE_IF_GIVEN) -> list[str]:
    """Names on which stored and current metadata differ; all of them where nothing is stored."""
    if stored is None:
        return list(agree)
    text = lambda v: None if v is None else str(v)
    return [k for k in (*agree, *(k for k in if_given if k in current)) if stored.get(k) != text(current.get(k))]


# -- manifests --------------------------------------------------------------


def write_manifest(docs: DataFrame, path: str, limit: int | None = None) -> None:
    """The ids in scope (the first ``limit`` by id, else all), their number, and when it was written."""
    spark, ids = docs.sparkSession, docs.select("doc_id").where("doc_id is not null").distinct()
    ids = ids if limit is None else ids.orderBy("doc_id").limit(limit)
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    written = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first().t
    write_meta(spark, f"{path}/meta", {"n_docs": ids.count(), "limit": limit, "ids_fingerprint": fingerprint(ids), "created_utc": written})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ids")


def manifest_is_current(docs: DataFrame, path: str, limit: int | None = None) -> bool:
    """Whether a manifest has just the ids that write_manifest would write now."""
    meta = read_meta(docs.sparkSession, f"{path}/meta")
    if meta is None or meta.get("limit") != (None if limit is None else str(limit)):
        return False
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    ids = ids if limit is None else ids.orderBy("doc_id").limit(limit)
    return meta["ids_fingerprint"] == fingerprint(ids)


# -- vectors ----------------------------------------------------------------


@dataclass
class VectorStore:
    """Vectors of chunks by strategy: chunk_uid, doc_id, pos, text, vector."""

    spark: SparkSession
    path: str
    embedder: type[Embedder] = HashingEmbedder

    def read(self, strategy: str) -> DataFrame | None:
        rows = opened(self.spark, self.path)
        return None if rows is None else rows.where(F.col("strategy") == strategy)

    def state(self, chunks: DataFrame, strategy: str) -> str:
        """``skip``: all chunks are stored; ``resume``: some are; ``build``: none; ``rebuild``: there are others than these."""
        stored = self.read(strategy)
        if stored is None:
            return "build"
        ids, uids = stored.select("chunk_uid", F.lit(1).alias("s")), chunks.select("chunk_uid", F.lit(1).alias("c"))
        n = ids.join(uids, "chunk_uid", "full_outer").agg(F.count("s").alias("stored"), F.count("c").alias("wanted"), F.count_if(F.col("c").isNull()).alias("foreign")).first()
        if n.foreign or n.stored > n.wanted:
            return "rebuild"
        return "skip" if n.stored == n.wanted else "resume" if n.stored else "build"

    def fill(self, chunks: DataFrame, strategy: str) -> str:
        """Embed and append the chunks (chunk_uid, doc_id, pos, text) that aren't stored, and tell the state found; a rebuild begins anew."""
        found = self.state(chunks, strategy)
        if found == "skip":
            return found
        missing, mode = chunks.select("chunk_uid", "doc_id", "pos", "text"), "append"
        if found == "resume":
            missing = missing.join(self.read(strategy).select("chunk_uid"), "chunk_uid", "left_anti")
        elif found == "rebuild":
            mode = "overwrite"
        rows = embed(missing, "text", self.embedder).withColumn("strategy", F.lit(strategy))
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(self.path)
        return found


# -- candidates and results -------------------------------------------------


def write_candidates(candidates: DataFrame, path: str, eval_id: str, meta: dict[str, object]) -> None:
    """Ranked candidates (strategy, retriever, query_id, doc_id, pos, rank, score) of an evaluation, with how they were made."""
    rows = candidates.select("strategy", "retriever", "query_id", "doc_id", "pos", "rank", "score")
    rows.write.mode("overwrite").partitionBy("strategy", "retriever").parquet(f"{path}/{eval_id}/rows")
    write_meta(candidates.sparkSession, f"{path}/{eval_id}/meta", {"version": VERSION, "eval_id": eval_id} | meta)


def read_candidates(spark: SparkSession, path: str, eval_id: str, meta: dict[str, object]) -> DataFrame:
    """Stored candidates; an error if they were made with other settings."""
    if wrong := differences(read_meta(spark, f"{path}/{eval_id}/meta"), {"version": VERSION, "eval_id": eval_id} | meta):
        raise ValueError(f"candidates of {eval_id} were made with other settings: {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/{eval_id}/rows")


def stored_queries(candidates: DataFrame) -> DataFrame:
    """strategy, retriever, n: queries with stored candidates."""
    return candidates.groupBy("strategy", "retriever").agg(F.count_distinct("query_id").alias("n"))


def unfinished(cells: DataFrame, done: DataFrame | None, n_queries: int, stored: dict[str, str | None] | None = None, current: dict[str, object] | None = None) -> DataFrame:
    """Requested cells (strategy, retriever) that have no result for each of n_queries; all of them if the settings differ.

    done: strategy, retriever, query_id, first_hit. A cell with more or fewer rows than queries counts as not done.
    """
    if done is None or (current is not None and differences(stored, current, tuple(current), ())):
        return cells
    full = done.groupBy("strategy", "retriever").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("d"))
    return cells.join(full.where((F.col("n") == n_queries) & (F.col("d") == n_queries)), ["strategy", "retriever"], "left_anti")
