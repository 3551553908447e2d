"""What the operators share: table access, Arrow helpers, written intermediate tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.shared import done_with, materialize
from corpusmill.sources.tables import table

__all__ = ["LOWER", "WORDS", "crc_column", "doc_crc", "done_with", "materialize", "pieces", "raw", "strings", "table", "texts"]

#: bytes.translate table: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A-Z to a-z; every ASCII byte that is neither a letter nor a digit becomes a space.
#: Bytes of 128 and more belong to words.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no extra column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, mb: float = 32) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows and, unless one row has more, a few MB of text, so that derived arrays stay small."""
    for batch in batches:
        size = np.zeros(batch.num_rows)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            most = (ends[start - 1] if start else 0) + mb * 1e6
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column; null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def doc_crc(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(doc_id: str = "doc_id") -> F.Column:
    """doc_crc as a column."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
