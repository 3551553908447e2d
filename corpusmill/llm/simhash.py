"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint is the majority vote of the XXH64 (seed 42) of its
three-word shingles. Distinct fingerprints are linked at 3 or fewer differing
bits, and documents get the smallest doc_id reachable over links.

Plan, in terms of distinct fingerprints only (copies collapse first, in a
partial aggregate):

1. 64 bits are cut into 4 blocks; two fingerprints with at most 3 differing
   bits agree on one block. Each fingerprint goes to its 4 blocks' buckets.
2. A bucket of more than ``GROUP`` fingerprints is cut again, exactly: its
   members are split by 4 sub-blocks of the remaining bits (48, then 36). What
   is still larger is processed as pairs of chunks. Bucket sizes are partial counts,
   and members of large buckets leave before the rest is dealt out by bucket, so no
   task gets more than ``GROUP`` of one.
3. Within a bucket, fingerprints are sorted by Gray rank and a tree is built
   whose nodes hold the bits on which all members agree; children keep only
   the bits that their parent doesn't hold. A search adds up differences from
   the root and drops a whole group as soon as they exceed 3.
4. A bucket yields links to the representative of its local component, so
   their number is linear. Components of all buckets are joined by
   alternating large-star and small-star steps on written tables.

Nulls, empty texts and texts without a word have fingerprint zero and are
linked like any other. Repeated rows give repeated results. A null doc_id
never becomes a component id unless all ids of the component are null. Very long texts are read whole,
an empty table gives no rows, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, materialize, pieces, raw
from corpusmill.operators.graph import components

DISTANCE = 3
#: Most fingerprints of a bucket that are searched as one.
GROUP = 65_536
FANOUT = 16
BLOCK = 256
SMALL = 64


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    shingles = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
    votes = np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64, n)
    for start in range(0, n, 65_536):
        part = hashes[start : start + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The whole numbers ``keep``, fp (the 64 bits as a signed long)."""
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(x) for x in raw(batch.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], names)

    rows = docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in keep))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Tree over Gray-sorted fingerprints; levels[k] = (values, masks), masks without the bits the parent holds."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        low, high = fps, fps
        full = []
        while True:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            full.append((low, ~(low ^ high)))
            if len(low) <= FANOUT:
                break
        self.levels = []
        for k, (values, masks) in enumerate(full):
            own = masks
            if k + 1 < len(full):
                own = masks & ~full[k + 1][1][np.arange(len(masks)) // FANOUT]
            self.levels.append((values, own))
        self.leaf_rest = ~full[0][1]

    def search(self, queries: np.ndarray, first: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position from ``first``, position) within DISTANCE, positions above the query's.

        With labels, leaves whose members all share the query's label are skipped.
        """
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        q = np.repeat(np.arange(len(queries)), n)
        node = np.tile(np.arange(n), len(queries))
        seen = np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            values, masks = self.levels[k]
            seen = seen + np.bitwise_count((queries[q] ^ values[node]) & masks[node])
            span = FANOUT ** (k + 1)
            keep = (seen <= DISTANCE) & ((node + 1) * span > first + q)
            if k == 0 and labels is not None:
                at = np.arange(0, len(labels), FANOUT)
                low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
                keep &= ~((low[node] == high[node]) & (low[node] == labels[first + q]))
            q, node, seen = q[keep], node[keep], seen[keep]
            below = len(self.levels[k - 1][0]) if k else len(self.fps)
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, seen = np.repeat(q, FANOUT), np.repeat(seen, FANOUT)
            real = child < below
            q, node, seen = q[real], child[real], seen[real]
        seen = seen + np.bitwise_count((queries[q] ^ self.fps[node]) & self.leaf_rest[node // FANOUT])
        hit = (seen <= DISTANCE) & (node > first + q)
        return first + q[hit], node[hit]


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of i and j; labels are flat before and after."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := labels[labels], labels):
            labels = flat
    return labels


def group_labels(fps: np.ndarray) -> np.ndarray:
    """For distinct Gray-sorted fingerprints: position of the representative of each one's component."""
    labels = np.arange(len(fps))
    index = GrayIndex(fps)
    for first in range(0, len(fps), BLOCK):
        i, j = index.search(fps[first : first + BLOCK], first, labels)
        labels = unite(labels, i, j)
    return labels


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) within the groups of equal key."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps = keys[order], fps[order]
    labels = np.arange(len(fps))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        labels[start : start + size] = start + group_labels(fps[start : start + size])
    small = np.repeat(sizes <= SMALL, sizes)
    at, near = [], []
    for lag in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=1)))):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[:-lag])
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= DISTANCE]
        at.append(i)
        near.append(i + lag)
    if at:
        labels = unite(labels, np.concatenate(at), np.concatenate(near))
    other = labels != np.arange(len(fps))
    return fps[other], fps[labels[other]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), all rows of a key in one partition and sorted by key; a cut group waits for its rest."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys) < 4 * BLOCK:
            continue
        cut = np.searchsorted(keys, keys[-1])
        if cut:
            yield _links(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield _links(keys, fps)


def _links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    a, b = linked(keys, fps)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _split(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, key, rest) by 4 blocks of the ``bits`` bits in rest; key grows by the block's number and value."""
    quarter = bits // 4

    def block(j: int) -> F.Column:
        shift = quarter * j
        rest = F.col("rest")
        value = F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << quarter) - 1))
        turned = F.shiftrightunsigned(rest, (shift + quarter) % 64) if shift + quarter < bits else rest
        if 0 < shift + quarter < bits:
            turned = turned.bitwiseOR(F.shiftleft(rest, bits - shift - quarter))
        left = turned.bitwiseAND(F.lit((1 << (bits - quarter)) - 1))
        return F.struct((F.col("key") * (4 << quarter) + j * (1 << quarter) + value).alias("key"), left.alias("rest"))

    return rows.select("fp", F.explode(F.array(*map(block, range(4)))).alias("x")).select("fp", "x.key", "x.rest")


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that are within DISTANCE."""
    rows = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    found = []
    for bits in (64, 48, 36):
        blocks = _split(rows, bits)
        sizes = blocks.groupBy("key").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > group), f"simhash-sizes-{bits}")
        whole = large.isEmpty()
        fit = blocks if whole else blocks.join(large, "key", "left_anti")
        found.append(fit.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_search, "a long, b long"))
        if whole:
            break
        rows = materialize(blocks.join(large, "key").select("fp", "key", "rest", "n"), f"simhash-large-{bits}")
    else:
        chunks = F.ceil(F.col("n") / (group // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        pairs = rows.withColumn("own", own).select(
            "fp", "key", "own", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
        )
        pairs = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        found.append(
            pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_search, "a long, b long")
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def rooted(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Distinct fingerprints fp, with the root of their component besides their other columns."""
    roots = components(links(nodes, group))
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def survivors(docs: DataFrame, order: tuple[str, ...], group: int = GROUP) -> DataFrame:
    """``order`` of the first row of each component, nulls of a column last, and how many rows have the same."""
    fps = materialize(fingerprints(docs, order), "fingerprints")
    ranked = F.struct(*(c for name in order for c in (F.col(name).isNull().alias(f"{name}_null"), F.col(name))))
    nodes = fps.groupBy("fp", *order).agg(F.count("*").alias("times")).groupBy("fp").agg(F.min(F.struct(ranked.alias("row"), "times")).alias("least"))
    least = rooted(nodes, group).groupBy("root").agg(F.min("least").alias("least"))
    return least.select(*(F.col(f"least.row.{name}").alias(name) for name in order), "least.times")


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs."""
    fps = materialize(fingerprints(docs), "fingerprints")
    named = rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), group)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
