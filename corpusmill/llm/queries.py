"""The contract queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import ctw, decontaminate, html, langid, licenses, neighbours, packing, pii, simhash, toxicity
from corpusmill.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.pages_text(table(spark, sf_dir, "pages"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op8_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_vantage_point_neighbours": op2_vantage_point_neighbours,
    "op3_html_layout_text": op3_html_layout_text,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_simhash": op5_simhash,
    "op6_hyperdimensional_langid": op6_hyperdimensional_langid,
    "op7_context_tree_weighting": op7_context_tree_weighting,
    "op8_bilstm_crf_pii": op8_bilstm_crf_pii,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
}

ORACLE_SQL: dict[str, str] = {}
