"""Training corpus in five stages, each reading what the one before it wrote.

1. ``language``: documents without a determinable language go (null, empty or without a letter).
2. ``near_duplicates``: of each SimHash component the document with the smallest id stays (one without an id only if none has one).
3. ``decontaminate``: documents that overlap a benchmark item go.
4. ``pii``: personal data in texts is replaced by its kind in brackets; no document goes.
5. ``pack``: what is left is packed into sequences of 1024 tokens.

Stages 1 to 4 return the columns of documents. Documents are rows: those without a doc_id or with
the doc_id of another are treated like all others. A null lang or
source stays null. n_chars follows the text where stage 4 changes it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, langid, packing, pii, simhash
from corpusmill.llm.common import materialize, pieces, strings, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a determinable language; prediction runs where the row is, so nothing is joined."""
    docs = _columns(docs)
    learned = langid.fit(langid.training_rows(docs))
    return langid.annotate(docs, *learned).where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: the smallest doc_id, nulls last, then the smallest hash of the whole row.

    Texts move once, by two hashes of the row, at any size: the rows to keep grow with the input, so they aren't broadcast.
    """
    docs = _columns(docs)
    nulls = [F.col(c).isNull() for c in COLUMNS]
    docs = docs.withColumns({"h1": F.xxhash64(*COLUMNS, *nulls), "h2": F.xxhash64(F.lit(1), *nulls, *reversed(COLUMNS))})
    kept = materialize(simhash.survivors(docs, ("doc_id", "h1", "h2")).select("h1", "h2", "times"), "kept")
    joined = docs.join(kept.hint("shuffle_hash"), ["h1", "h2"])
    again = joined.where("times > 1").dropDuplicates(["h1", "h2"])
    return joined.where("times = 1").unionAll(again).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate.clean(_columns(docs), table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts."""
    docs = _columns(docs)
    shared = spark.sparkContext.broadcast(pii.fit(docs))
    schema = docs.schema

    def run(batches):
        for batch in pieces(batches, pii.BATCH):
            bodies = strings(batch.column(1))
            found = [pii.spans(x, own, pii.base_spans(x)) for x, own in zip(bodies, shared.value.decoded(bodies), strict=True)]
            texts, sizes = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    texts[i] = pii.masked(bodies[i], spans)
                    sizes[i] = len(texts[i])
            columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(sizes, batch.column(4).type)]
            yield pa.RecordBatch.from_arrays(columns, list(COLUMNS))

    return docs.mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(_columns(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", without_pii),
    ("pack", pack),
]

#: SQL has neither the fingerprints nor the models nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
