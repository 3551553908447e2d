"""Ten chunking strategies as one row-to-rows operator.

A strategy is a ``ChunkSpec``: a splitter and its parameters. Splitters work on
whole texts inside Arrow batches, since overlap and greedy merging depend on
what came before; a document's chunks don't depend on any other document, so
nothing is shuffled.

``pos`` counts a document's chunks from 0. ``chunk_uid`` is derived from document, strategy and
pos; ``global_index`` gives the running number over the whole corpus where a caller wants it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import chunk_uid
from corpusmill.sources.shared import materialize

DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
LEGAL_SEPARATORS = ("\nArticle ", "\nCHAPTER ", *DEFAULT_SEPARATORS)


def _fill(parts: list[str], glue: str, size: int, overlap: int) -> Iterator[str]:
    """Greedy windows of consecutive parts up to ``size``; the next window keeps trailing parts up to ``overlap``."""
    window: list[str] = []
    used = 0
    for part in parts:
        more = len(part) + (len(glue) if window else 0)
        if window and used + more > size:
            if body := glue.join(window).strip():
                yield body
            while window and (used > overlap or used + len(part) + len(glue) > size):
                used -= len(window[0]) + (len(glue) if len(window) > 1 else 0)
                del window[0]
            more = len(part) + (len(glue) if window else 0)
        window.append(part)
        used += more
    if body := glue.join(window).strip():
        yield body


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = DEFAULT_SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, kept at the start of what follows; too long pieces by the next ones."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        head, *tail = text.split(mark)
        parts = [p for p in (head, *(mark + x for x in tail)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        out += _fill(short, "", size, overlap)
        short = []
        out += recursive(part, size, overlap, rest) if rest else [part]
    return out + list(_fill(short, "", size, overlap))


def by_character(text: str, size: int, overlap: int, mark: str = "\n\n") -> list[str]:
    """Split at one separator, merge with it, and split what is still too long recursively by finer ones."""
    out = []
    for piece in _fill([p for p in text.split(mark) if p], mark, size, overlap):
        out += [piece] if len(piece) <= size else recursive(piece, size, overlap, ("\n", " ", ""))
    return out


def merged_paragraphs(text: str, size: int) -> list[str]:
    """Paragraphs without outer white space, joined up to ``size``; a longer one alone, split recursively."""
    out: list[str] = []
    batch: list[str] = []
    used = 0
    for unit in (p for p in (x.strip() for x in text.split("\n\n")) if p):
        if batch and used + 2 + len(unit) > size:
            out.append("\n\n".join(batch))
            batch, used = [], 0
        if len(unit) > size:
            out += recursive(unit, size, 0)
            continue
        used += len(unit) + (2 if batch else 0)
        batch.append(unit)
    if batch:
        out.append("\n\n".join(batch))
    return out


def merged_lines(text: str, size: int) -> list[str]:
    """A blank line can't begin a text's first batch or follow a too long line; it may begin a batch after a full one."""
    out: list[str] = []
    batch: list[str] = []
    used = 0
    for line in (x.rstrip() for x in text.split("\n")):
        if not line and not batch:
            continue
        if batch and (len(line) > size or used + 1 + len(line) > size):
            out.append("\n".join(batch))
            batch = []
            if len(line) <= size:
                batch, used = [line], len(line)
                continue
        if len(line) > size:
            out += recursive(line, size, 0)
            continue
        used = used + 1 + len(line) if batch else len(line)
        batch.append(line)
    if batch:
        out.append("\n".join(batch))
    return out


@dataclass(frozen=True)
class ChunkSpec:
    strategy: str
    split: Callable[..., list[str]]
    parameters: tuple

    def __call__(self, text: str) -> list[str]:
        return self.split(text, *self.parameters)


SPECS: dict[str, ChunkSpec] = {}


def register(strategy: str, split: Callable[..., list[str]], *parameters) -> ChunkSpec:
    """Add a strategy; a second one of the same name is an error."""
    if strategy in SPECS:
        raise ValueError(f"strategy {strategy} is registered already")
    SPECS[strategy] = ChunkSpec(strategy, split, parameters)
    return SPECS[strategy]


for _size, _overlap in ((500, 50), (1000, 100), (1500, 150), (2000, 0), (2000, 200)):
    register(f"len_{_size}_o{_overlap}", recursive, _size, _overlap)
register("para_nn_merge", merged_paragraphs, 2000)
register("line_n_merge", merged_lines, 2000)
register("char_nn_only", by_character, 2000, 100)
register("rec_nn_priority", recursive, 2000, 100)
register("rec_legal_markers", recursive, 2000, 150, LEGAL_SEPARATORS)

DEFAULT = ChunkSpec("default", recursive, (2000, 0))


def specs(strategies: list[str]) -> list[ChunkSpec]:
    unknown = [s for s in strategies if s not in SPECS]
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    return [SPECS[s] for s in strategies]


def longest_word(text: str | None) -> str:
    """The longest run of ASCII letters and digits in lower case, empty if there is none."""
    return max(re.findall("[A-Za-z0-9]+", text or ""), key=len, default="").lower()


def chunk(docs: DataFrame, strategies: list[str] | list[ChunkSpec], keep: tuple[str, ...] = (), having: str | None = None) -> DataFrame:
    """strategy, doc_id, pos, chunk_uid, text and the columns of ``keep``; several strategies in one scan.

    having: a kept column; chunks without the longest word of its value, in whatever case, are left out, as they can't contain() it.
    """
    missing = {"doc_id", "text", *keep} - set(docs.columns)
    if missing:
        raise ValueError(f"documents lack {', '.join(sorted(missing))}")
    chosen = [s if isinstance(s, ChunkSpec) else specs([s])[0] for s in strategies]
    docs = docs.select("doc_id", "text", *keep)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField("strategy", T.StringType()), *kept, T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows, names, places, bodies = [], [], [], []
                wanted = [longest_word(x) for x in batch.column(having).to_pylist()] if having else [""] * batch.num_rows
                for row, (text, word) in enumerate(zip(batch.column("text").to_pylist(), wanted, strict=True)):
                    for spec in chosen:
                        pieces = spec(text or "")
                        at = [i for i, piece in enumerate(pieces) if word in piece.lower()] if word else range(len(pieces))
                        rows += [row] * len(at)
                        names += [spec.strategy] * len(at)
                        places += at
                        bodies += (pieces[i] for i in at)
                if rows:
                    taken = batch.take(pa.array(rows))
                    columns = [pa.array(names), *(taken.column(f.name) for f in kept), pa.array(places, pa.int32()), pa.array(bodies, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("chunk_uid", chunk_uid("doc_id", "strategy", "pos"))


def global_index(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``idx``, their number from 0 in the given order.

    Sorted ranges are written, numbered on their own and shifted by the sizes of those
    before them, so no task sees more than its range.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", before.alias("_shift"))  # a row for each range
    return ranged.withColumn("_within", within).join(F.broadcast(shifts), "_range").withColumn("idx", F.col("_within") + F.col("_shift")).drop("_range", "_within", "_shift")


def statistics(chunks: DataFrame) -> DataFrame:
    """Median length by strategy, and the words a rewritten question should have."""
    median = F.percentile(F.length("text"), F.lit(0.5))
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), median.alias("median_chars")).withColumn(
        "target_words", F.greatest(F.lit(60), F.least(F.lit(250), F.col("median_chars") / 6)).cast("int")
    )
