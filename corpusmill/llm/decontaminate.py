"""Benchmark decontamination with spaced seeds.

Words (A-Z lower-cased; letters, digits and bytes from 128) of benchmark items
are hashed at the positions that a fixed mask keeps; the same is done over all
of each document, and equal hashes join. A mask's ignored positions may hold
other words, so a passage with some words substituted still shares a hash.
Each hit is a diagonal (item, document offset); along it the words are
compared, and a segment is an overlap if it has ``OVERLAP`` words, or ``SHARE`` of
a shorter item's, and ``SAME`` of them are equal. Of a diagonal the segment of the largest sum (+1 for
an equal word, -2 for another) is told if it is an overlap, or else the longest that is.

Items of which ``SHARE`` is under ``OVERLAP`` words have masks of their own, ``SHORT``: every
overlap with them shares a hash. Those of fewer than ``LEAST`` words overlap only as a whole and verbatim. The
benchmark goes to the executors in blocks of at most ``BLOCK_MB`` of text, one pass
over the documents for each block, so what is broadcast has a fixed bound.

A null or empty text overlaps nothing. Several rows of a doc_id or item_id are searched
each; a document's overlaps with an item are told once, the longest, then the
first. Null ids stay null. Very long texts are searched whole; an empty table of documents or items gives no
rows; of documents only doc_id and text are read, of items item_id and text, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORDS, pieces, raw, texts

#: Every segment of OVERLAP words or more with SAME of them equal shares a hash of one of these; SHORT does so for short items.
MASKS = ("111011", "11111")
SHORT = ("11101", "1111")
OVERLAP = 13
SHARE = 0.8
SAME = 0.8
LEAST = 8
BLOCK_MB = 16

SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long, similarity double"


@cache
def multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)


def seed_hashes(words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows whose kept words are all known (not zero)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kept = [i for i, x in enumerate(mask) if x == "1"]
    known = np.ones(n, bool)
    for i in kept:
        known &= words[i : i + n] != 0
    at = np.flatnonzero(known)
    hashes = np.full(len(at), len(mask), np.uint64)
    for k, i in enumerate(kept):
        x = words[at + i].astype(np.uint64) * multipliers()[k]
        hashes += x ^ (x >> np.uint64(31))
    return at, hashes


def least_words(n: int) -> int:
    """Words that an overlap with an item of n words has at least."""
    return n if n < LEAST else min(OVERLAP, math.ceil(SHARE * n))


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], masks: tuple[str, ...] = MASKS) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            words = text.translate(WORDS).split()
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.masks: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for mask in ("1" * len(w),) if len(w) < LEAST else SHORT if least_words(len(w)) < OVERLAP else masks:
                self.masks.setdefault(mask, []).append(i)
        self.seeds = {}
        for mask, those in self.masks.items():
            found = [(i, *seed_hashes(self.words[i], mask)) for i in those]
            if not found:
                continue
            hashes = np.concatenate([h for *_, h in found])
            item = np.concatenate([np.full(len(h), i) for i, _, h in found])
            at = np.concatenate([a for _, a, _ in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds[mask] = hashes[order], item[order], at[order]

    def diagonals(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, document position - item position) of all hits."""
        out = []
        for mask, (hashes, item, at) in self.seeds.items():
            place, found = seed_hashes(words, mask)
            low = np.searchsorted(hashes, found)
            hit = low < len(hashes)
            hit[hit] = hashes[low[hit]] == found[hit]
            place, found, low = place[hit], found[hit], low[hit]
            times = np.searchsorted(hashes, found, "right") - low
            use = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            out.append(np.stack([item[use], np.repeat(place, times) - at[use]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)

    def overlaps(self, text: bytes) -> list[tuple]:
        """(item_id, doc_word, item_word, n_words, n_same, similarity), one for each item."""
        known = self.vocabulary.get
        words = np.array([known(w, 0) for w in text.translate(WORDS).split()], np.int64)
        best: dict[int, tuple] = {}
        for i, shift in self.diagonals(words).tolist():
            item = self.words[i]
            low, high = max(0, -shift), min(len(item), len(words) - shift)
            same = item[low:high] == words[low + shift : high + shift]
            needed = least_words(len(item))
            if high - low < needed:
                continue
            first, last = segment(same)
            n, equal = last - first, int(same[first:last].sum())
            if equal < SAME * n or n < needed:
                first, last = longest(same)
                n, equal = last - first, int(same[first:last].sum())
                if n < needed:
                    continue
            row = (n, -(low + first + shift), low + first, equal)
            if i not in best or row > best[i]:
                best[i] = row
        out: dict[int | None, tuple] = {}
        for i, row in best.items():
            if self.ids[i] not in out or row > out[self.ids[i]]:
                out[self.ids[i]] = row
        return [(item_id, -at, item_at, n, equal, equal / n) for item_id, (n, at, item_at, equal) in out.items()]


def segment(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the segment of the largest sum of +1 (equal) and -2."""
    sums = np.r_[0, np.cumsum(np.where(same, 1, -2))]
    least = np.minimum.accumulate(sums)
    last = int(np.argmax(sums - least))
    return int(np.argmin(sums[: last + 1])), last


def longest(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the longest segment with ``SAME`` of its words equal, the first of several."""
    share = Fraction(str(SAME))
    sums = np.r_[0, np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))]
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    last = int(np.argmax(np.arange(len(sums)) - first))
    return int(first[last]), last


def blocks_of(benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_mb: float = BLOCK_MB) -> Iterator[Index]:
    """Indexes over all items, each over at most about ``block_mb`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(size / (block_mb * 1e6)) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow()
        yield Index(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), masks)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_mb: float = BLOCK_MB) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    out = None
    for index in blocks_of(benchmark, masks, block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                rows = [
                    (doc_id, *row)
                    for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True)
                    for row in shared.value.overlaps(text)
                ]
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.float64()]
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        found = texts(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows of docs (doc_id, text first) that overlap no item; decided where the row is, so nothing is joined."""
    for index in blocks_of(benchmark, masks, block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                yield batch.filter(pa.array([not shared.value.overlaps(x) for x in raw(batch.column(1))]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
