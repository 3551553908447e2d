"""Approximate nearest neighbours by largest inner product: a vantage-point tree in each shard.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm of their
shard, and queries a zero: then the largest inner product is the least Euclidean
distance, a metric. A node splits its points at the median distance from a
vantage point and keeps the bounds of both halves. A half is left out if
``factor`` times the triangle-inequality bound exceeds the distance of the
k-th best so far; factor 1 is exact search, larger ones leave out more.

Rows are dealt by a hash of vec_id and written once; each task cuts what it reads into shards of
``SHARD`` vectors, so a tree has a bounded size however large the table is. Every row is indexed. Queries are a stated
set and go to the tasks in broadcast blocks of at most ``BLOCK_MB``, one pass over the rows for each block. A task keeps one
list of the k best of each query over all its shards, whose last entry also bounds the search of the
next shard, and hands the lists on at its end: k rows for each query and task are shuffled, whatever the number of shards.
Scores are computed anew in double precision, component by component in the same order for all, from the
original vectors.

Equal vectors of a shard are one point of the tree with their k + 1 smallest
ids: no more of them can be among the k best, so a vector that fills a third of
the table costs no more than any other. Vectors that are null, empty, zero, or
hold null or non-finite components take no part, nor do rows without vec_id. Of rows
that share a vec_id the smallest vector counts. Vectors of different
lengths are no candidates of each other. Ties go to the smaller vec_id. An empty table has no
queries and no rows. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize

NONE = np.iinfo(np.int64).max
K = 20
FACTOR = 1.5
SHARD = 4096
LEAF = 64
#: Vectors of a block of queries, and queries that search a tree together.
BLOCK_MB = 16
TOGETHER = 1024


class Tree:
    """Vantage-point tree over the rows of ``points`` (already with the further component)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.points = points
        self.nodes: list[tuple] = []  # (None, rows) or (vantage row, inner, outer, most inside, least outside)
        waiting = [(np.arange(len(points)), None, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1 + side] = me
            if len(rows) <= leaf:
                self.nodes.append([None, rows])
                continue
            vantage = int(rows[rng.integers(len(rows))])
            far = np.sqrt(np.maximum(0, ((points[rows] - points[vantage]) ** 2).sum(axis=1)))
            half = len(rows) // 2
            order = np.argpartition(far, half)
            inner, outer = order[:half], order[half:]
            self.nodes.append([vantage, None, None, float(far[inner].max()), float(far[outer].min())])
            waiting += [(rows[outer], me, 1), (rows[inner], me, 0)]

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, limit: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """(rows of the k nearest of each query, -1 where there are fewer; how many distances to leaf points).

        limit: a distance for each query beyond which nothing is wanted.
        """
        n, k = len(queries), min(k, len(self.points))
        limit = np.full(n, np.inf) if limit is None else limit
        near, best, compared = np.full((n, k), np.inf), np.full((n, k), -1), 0
        squares = (queries**2).sum(axis=1)
        norms = (self.points**2).sum(axis=1)

        def look(rows: np.ndarray, active: np.ndarray) -> None:
            nonlocal compared
            compared += len(rows) * len(active)
            d = squares[active, None] + norms[rows] - 2 * queries[active] @ self.points[rows].T
            d = np.concatenate([near[active], np.sqrt(np.maximum(0, d))], axis=1)
            at = np.concatenate([best[active], np.broadcast_to(rows, (len(active), len(rows)))], axis=1)
            keep = np.argpartition(d, k - 1, axis=1)[:, :k]
            near[active], best[active] = np.take_along_axis(d, keep, 1), np.take_along_axis(at, keep, 1)

        def distance(vantage: int, active: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, squares[active] + norms[vantage] - 2 * queries[active] @ self.points[vantage]))

        home = np.zeros(n, np.int64)
        waiting = [(0, np.arange(n))]
        while waiting:  # each query's own leaf first, for a first bound
            me, active = waiting.pop()
            if not len(active):
                continue
            node = self.nodes[me]
            if node[0] is None:
                home[active] = me
                look(node[1], active)
            else:
                inside = distance(node[0], active) <= (node[3] + node[4]) / 2
                waiting += [(node[1], active[inside]), (node[2], active[~inside])]
        waiting = [(0, np.arange(n), np.zeros(n))]
        while waiting:
            me, active, bound = waiting.pop()
            open_ = factor * bound <= np.minimum(near[active].max(axis=1), limit[active])
            active = active[open_]
            if not len(active):
                continue
            node = self.nodes[me]
            if node[0] is None:
                if len(other := active[home[active] != me]):
                    look(node[1], other)
            else:
                d = distance(node[0], active)
                waiting += [(node[2], active, np.maximum(bound[open_], node[4] - d)), (node[1], active, np.maximum(bound[open_], d - node[3]))]
        return best, compared


class Asked:
    """A block of queries with the k best that a task has found for each."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> None:
        self.k, sizes = k, np.array([len(v) for v in vectors])
        self.groups = {}
        for size in np.unique(sizes):
            use = np.flatnonzero(sizes == size)
            q = np.stack([vectors[i] for i in use])
            self.groups[int(size)] = (ids[use], q, (q**2).sum(axis=1), np.full((len(use), k), -np.inf), np.full((len(use), k), NONE))

    def search(self, ids: np.ndarray, x: np.ndarray, factor: float) -> None:
        """Look through a shard: distinct ids and their vectors, all of one length."""
        asked, q, squares, scores, found = self.groups[x.shape[1]]
        distinct, at = np.unique(x, axis=0, return_inverse=True)
        at = at.ravel()
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        first = place <= self.k  # the k + 1 smallest ids of equal vectors
        members = np.full((len(distinct), int(place[first].max()) + 1), NONE)
        members[at[first], place[first]] = ids[first]
        norms = (distinct**2).sum(axis=1)
        most = norms.max()
        tree = Tree(np.c_[distinct, np.sqrt(np.maximum(0, most - norms))])
        for a in range(0, len(q), TOGETHER):
            part = slice(a, a + TOGETHER)
            limit = np.sqrt(np.maximum(0, squares[part] + most - 2 * scores[part].min(axis=1))) * (1 + 1e-9) + 1e-9
            best, _ = tree.search(np.c_[q[part], np.zeros(len(q[part]))], self.k + 1, factor, limit)
            value = (distinct[best] * q[part][:, None, :]).sum(axis=2)
            own = members[best]
            fine = (best >= 0)[:, :, None] & (own != NONE) & (own != asked[part][:, None, None])
            value = np.where(fine, value[:, :, None], -np.inf).reshape(len(best), -1)
            own = np.where(fine, own, NONE).reshape(len(best), -1)
            value, own = np.concatenate([scores[part], value], axis=1), np.concatenate([found[part], own], axis=1)
            order = np.lexsort((own, -value), axis=1)[:, : self.k]
            scores[part], found[part] = np.take_along_axis(value, order, axis=1), np.take_along_axis(own, order, axis=1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for asked, _, _, scores, found in self.groups.values():
            there = found != NONE
            query = np.broadcast_to(asked[:, None], there.shape)[there]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found[there], pa.int64()), pa.array(scores[there], pa.float64())], ["query_id", "vec_id", "score"])


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, factor: float = FACTOR, shard: int = SHARD, block_mb: float = BLOCK_MB) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query; by default the rows whose vec_id is divisible by 20."""
    parts = 4 * embeddings.sparkSession.sparkContext.defaultParallelism
    one = lambda rows: rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = materialize(one(valid(embeddings).repartition(parts, "vec_id")), "vectors")
    asked = rows.where("vec_id % 20 = 0") if queries is None else materialize(one(valid(queries)), "asked")
    size = asked.agg(F.sum(F.size("vector") + 3)).first()[0] or 0
    blocks = int(size * 8 / (block_mb * 1e6)) + 1
    out = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((block.column(0).to_numpy(), [np.array(v.values) for c in block.column(1).chunks for v in c]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if not len(shared.value[0]):
                return
            held = Asked(*shared.value, k)
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def search(size: int) -> None:
                ids, x = (np.concatenate(v) for v in zip(*waiting.pop(size), strict=True))
                held.search(ids, x, factor)

            for batch in batches:
                for at in range(0, batch.num_rows, shard):
                    part = batch.slice(at, shard)
                    lists, ids = part.column(1), part.column(0).to_numpy(zero_copy_only=False)
                    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
                    starts = np.cumsum(sizes) - sizes
                    for n in np.unique(sizes).tolist():
                        if n in held.groups:
                            use = sizes == n
                            waiting.setdefault(n, []).append((ids[use], flat[starts[use][:, None] + np.arange(n)]))
                            if sum(len(x) for x, _ in waiting[n]) >= shard:
                                search(n)
            for n in list(waiting):
                search(n)
            yield from held.rows()

        found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionAll(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
