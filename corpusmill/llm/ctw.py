"""Language-model scoring by context-tree weighting, with a unigram baseline.

The model reads a text as bytes and predicts a byte bit by bit. A node is a
context of the 0 to ``DEPTH`` bytes before, with the bits of the byte so far;
it holds Krichevsky-Trofimov counts of the next bit. Context-tree weighting
mixes the nodes of all depths: ``P_w = (P_e + product of the children's P_w) / 2``,
so a node's own estimate has the weight ``P_e / (2 P_w)`` and the rest goes to the node
one byte deeper. Counts and weights are those after all training documents,
so a text's score doesn't depend on the order of documents.

Texts are read once, in chunks of about ``CHUNK_MB``; counts of byte sequences come from the
counts of each chunk, summed by a shuffle. The trees below two context bytes lie in one partition each and are
weighted there; the two top levels are sums over at most 65,280 rows.

All counted nodes are used. Training counts of byte sequences stay in a written table and
are never collected; only depths 0 and 1 are broadcast. The distinct byte sequences of each chunk go by a shuffle to the
partition that holds their subtree, which answers with their log probabilities; these go to
the chunk's texts by another shuffle. What a partition holds has a bound set from the counted sequences.

Byte sequences move packed: a row holds up to ``BLOB`` of those with the same two nearest bytes, so
the rows that Spark shuffles and sorts are thousands a chunk, not one for each sequence. Texts move
compressed, about ``TEXTS_MB`` of them in a row.

The baseline needs the training count of every token. The most frequent
tokens (``HEAD`` at most, each of at most ``HEAD_BYTES`` bytes) are broadcast;
all others are looked up by a join on the token, which is free of hot keys
since those are in the head.

Null and empty texts have the end token alone and log10 probability 0 under
the model. A null doc_id counts as the empty text for held_out. Repeated rows
train and are scored each time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, doc_crc, done_with, materialize, pieces, raw, texts

DEPTH = 5
#: Slots of the cache that is before a lookup; what it doesn't hold is looked up.
SLOT_BITS = 22
CHUNK_MB = 32
TEXTS_MB = 0.25
#: Rows hold up to some 100 kB, so pages and row groups are closed by bytes: what a task reads or writes at once stays small.
WRITTEN = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8, "parquet.enable.dictionary": False}
#: Distinct training sequences in a partition of the model, about.
PART = 300_000
#: Codes in a packed row, at most.
BLOB = 16_384
#: Codes that are summed by one task, about, before they are distinct.
SUMMED = 4_000_000
#: Codes that are answered at once, about.
ASKED = 1 << 19
HEAD = 131_072
HEAD_BYTES = 64
#: Distinct tokens that a worker counts before it hands them on.
HELD = 400_000
CHUNK = 1 << 20
END = b""


def held_out(doc_id: int | None) -> bool:
    return doc_crc(doc_id) % 5 == 1


def contexts(text: bytes) -> Iterator[np.ndarray]:
    """A code for each byte, in chunks: the DEPTH bytes before it, nearest first, then the byte. Before the start are zeros."""
    for start in range(0, len(text), CHUNK):
        part = np.frombuffer(text[max(0, start - DEPTH) : start + CHUNK], np.uint8)
        if start == 0:
            part = np.concatenate([np.zeros(DEPTH, np.uint8), part])
        x = part.astype(np.uint64)
        n = len(x) - DEPTH
        code = x[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            code |= x[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH + 1 - back))
        yield code


# -- packed rows ------------------------------------------------------------

KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
PAIR_BITS = 8 * (DEPTH - 1)


def batch_of(schema: str, rows: int, **given: pa.Array) -> pa.RecordBatch:
    """A batch with the columns of schema; those that aren't given are null."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, KINDS[kind]) for c, kind in fields], [c for c, _ in fields])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the lowest first, as many as the largest number needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(-1, size)
    out = np.zeros((size, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def packed_rows(schema: str, codes: np.ndarray, counts: np.ndarray | None = None, chunk: int | None = None) -> pa.RecordBatch:
    """Rows (pair, size, codes) of sorted codes, with their counts or chunk if given."""
    pair = codes >> np.uint64(PAIR_BITS)
    edges = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(codes)]
    cuts = [(start, min(start + BLOB, b)) for a, b in pairwise(edges) for start in range(a, b, BLOB)]
    low = codes & np.uint64((1 << PAIR_BITS) - 1)
    given = {
        "pair": pa.array([int(pair[a]) for a, _ in cuts], pa.int32()),
        "size": pa.array([b - a for a, b in cuts], pa.int64()),
        "codes": pa.array([packed(low[a:b]) for a, b in cuts], pa.binary()),
    }
    if counts is not None:
        given["counts"] = pa.array([packed(counts[a:b]) for a, b in cuts], pa.binary())
    if chunk is not None:
        given["chunk"] = pa.array([chunk] * len(cuts), pa.int64())
    return batch_of(schema, len(cuts), **given)


def unpacked_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """(pair, codes, values of each name or None) of packed rows."""
    for pair, size, codes, *values in zip(*(batch.column(c).to_pylist() for c in ("pair", "size", "codes", *names)), strict=True):
        yield pair, unpacked(codes, size) | np.uint64(pair << PAIR_BITS), *(None if x is None else unpacked(x, size) for x in values)


# -- counting ---------------------------------------------------------------

#: A row has a token and its count, a chunk's packed codes and counts, or a chunk's compressed texts and the key of the first.
CHUNKED = "token binary, n long, chunk long, pair int, size long, codes binary, counts binary, key long, texts binary"
GRAMS = "pair int, size long, codes binary, counts binary"


def compressed(doc_ids: pa.Array, bodies: list[bytes]) -> bytes:
    """doc_id and text of some documents."""
    batch = pa.RecordBatch.from_arrays([doc_ids, pa.array(bodies, pa.binary())], ["doc_id", "text"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def decompressed(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    return tuple(x.to_pylist() for x in pa.ipc.open_stream(blob).read_all().columns)


def chunked(docs: DataFrame, chunk_mb: float) -> DataFrame:
    """CHUNKED of documents: all texts, each chunk's distinct codes, and what training documents have of tokens and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = chunk = TaskContext.get().partitionId() << 40
        tokens: Counter = Counter()
        codes, new, unseen, waiting, size = _no_codes(), [], [], 0, 0
        for batch in pieces(batches, mb=TEXTS_MB):
            bodies = raw(batch.column(1))
            yield batch_of(CHUNKED, 1, chunk=pa.array([chunk]), key=pa.array([key]), texts=pa.array([compressed(batch.column(0), bodies)], pa.binary()))
            key += len(bodies)
            for doc_id, text in zip(batch.column(0).to_pylist(), bodies, strict=True):
                held = held_out(doc_id)
                if not held:
                    tokens.update(text.translate(LOWER).split())
                    tokens[END] += 1
                for x in contexts(text):
                    (unseen if held else new).append(x)
                    waiting += len(x)
                    if waiting >= CHUNK:
                        codes, new, unseen, waiting = _merged(codes, new, unseen), [], [], 0
                size += len(text)
            if len(tokens) >= HELD:
                yield _token_rows(tokens)
                tokens = Counter()
            if size >= chunk_mb * 1e6:
                yield packed_rows(CHUNKED, *_merged(codes, new, unseen), chunk)
                chunk, codes, new, unseen, waiting, size = key, _no_codes(), [], [], 0, 0
        if size:
            yield packed_rows(CHUNKED, *_merged(codes, new, unseen), chunk)
        if tokens:
            yield _token_rows(tokens)

    return texts(docs).mapInArrow(run, CHUNKED)


def _no_codes() -> tuple[np.ndarray, np.ndarray]:
    return np.empty(0, np.uint64), np.empty(0, np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their summed counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts, starts)


def _merged(held: tuple[np.ndarray, np.ndarray], new: list[np.ndarray], unseen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts with those of new codes; unseen ones, of held-out texts, count 0 times."""
    parts = [held]
    if new:
        codes, counts = np.unique(np.concatenate(new), return_counts=True)
        parts.append((codes, counts.astype(np.int64)))
    if unseen:
        codes = np.unique(np.concatenate(unseen))
        parts.append((codes, np.zeros(len(codes), np.int64)))
    return _added(parts)


def _token_rows(tokens: Counter) -> pa.RecordBatch:
    return batch_of(CHUNKED, len(tokens), token=pa.array(list(tokens), pa.binary()), n=pa.array(list(tokens.values()), pa.int64()))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS, codes distinct and seen in training, from packed rows sorted by pair, all of a pair in one partition."""
    held, waiting, size = _no_codes(), [], 0
    for batch in pieces(batches):
        for pair, codes, counts in unpacked_rows(batch, "counts"):
            if size >= CHUNK:
                held, waiting, size = _added([held, *waiting]), [], 0
                if cut := int(np.searchsorted(held[0], np.uint64(pair << PAIR_BITS))):
                    yield packed_rows(GRAMS, held[0][:cut], held[1][:cut])
                    held = held[0][cut:], held[1][cut:]
            seen = counts > 0
            waiting.append((codes[seen], counts[seen].astype(np.int64)))
            size += len(codes)
    held = _added([held, *waiting])
    if len(held[0]):
        yield packed_rows(GRAMS, *held)


# -- the model --------------------------------------------------------------


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(gamma(n + 0.5)) of whole numbers."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(256) + 0.5))]) + 0.5 * math.log(math.pi)
    x = np.maximum(n, 64) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 256, small[np.minimum(n, 256).astype(np.int64)], series)


def log_gamma(n: np.ndarray) -> np.ndarray:
    """log(gamma(n + 1)) of whole numbers."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 257)))])
    x = np.maximum(n, 64) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 256, small[np.minimum(n, 256).astype(np.int64)], series)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - log_gamma(zeros + ones) - math.log(math.pi)


def nodes_of(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, zeros, ones) of the nodes with ``depth`` context bytes, keys sorted."""
    byte = (codes & np.uint64(255)).astype(np.int64)
    context = (codes >> np.uint64(8 * (DEPTH - depth + 1))).astype(np.int64)
    keys = np.concatenate([(context << 8) | (1 << level) | (byte >> (8 - level)) for level in range(8)])
    bits = np.concatenate([(byte >> (7 - level)) & 1 for level in range(8)])
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.tile(counts, 8)
    return keys, *(np.bincount(at, np.where(bits == b, counts, 0), len(keys)) for b in (0, 1))


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log P_w, weight of the node's own estimate, estimate of a one); below: sums of the children's log P_w."""
    pe, kt = estimate(zeros, ones), (ones + 0.5) / (zeros + ones + 1.0)
    if below is None:
        return pe, np.ones_like(pe), kt
    pw = np.logaddexp(pe, below) - math.log(2)
    return pw, np.exp(pe - math.log(2) - pw), kt


def child_sums(keys: np.ndarray, below: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For sorted keys, sums of the values of nodes ``below`` that are one context byte deeper."""
    parents = ((below >> 16) << 8) | (below & 255)
    return np.bincount(np.searchsorted(keys, parents), values, len(keys))


def built(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """(depth, sorted keys, zeros, ones, weighted()) of the nodes from DEPTH to 2; all codes of a pair of nearest bytes are here."""
    below = None
    for depth in range(DEPTH, 1, -1):
        keys, zeros, ones = nodes_of(codes, counts, depth)
        values = weighted(zeros, ones, None if below is None else child_sums(keys, *below))
        below = (keys, values[0])
        yield depth, keys, zeros, ones, values


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


TOP_SCHEMA = "up int, zeros long, ones long, pw double"


def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 2 from packed rows sorted by pair, all of a pair in one partition."""

    def top(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        *_, (_, keys, zeros, ones, (pw, _, _)) = built(codes, counts)
        up = ((keys >> 16) << 8) | (keys & 255)
        arrays = [pa.array(up.astype(np.int32)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(pw)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in TOP_SCHEMA.split(", ")])

    waiting, size, now = [], 0, None
    for batch in pieces(batches):
        for pair, codes, counts in unpacked_rows(batch, "counts"):
            if pair != now and size >= 200_000:
                yield top(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, size = [], 0
            waiting.append((codes, counts.astype(np.int64)))
            size += len(codes)
            now = pair
    if waiting:
        yield top(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


class Scorer:
    """Sums of evaluate(), the log10 probabilities of distinct codes, over texts."""

    known: np.ndarray | None = None

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """evaluate() through a direct-mapped cache."""
        if self.known is None:
            self.known, self.logs = np.full(1 << SLOT_BITS, ~np.uint64(0)), np.zeros(1 << SLOT_BITS)
        at = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        out = self.logs[at]
        missing = np.flatnonzero(self.known[at] != codes)
        if len(missing):
            new, back = np.unique(codes[missing], return_inverse=True)
            found = self.evaluate(new)
            out[missing] = found[back]
            slots = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
            slots, last = np.unique(slots[::-1], return_index=True)
            self.known[slots], self.logs[slots] = new[::-1][last], found[::-1][last]
        return out

    def scores(self, texts_: list[bytes]) -> list[float]:
        """log10 probabilities of texts."""
        out, waiting, size = [0.0] * len(texts_), [], 0

        def flush() -> None:
            if waiting:
                logs = self.bits(np.concatenate([x for _, x in waiting]))
                starts = np.cumsum([0, *(len(x) for _, x in waiting)])[:-1]
                for (i, _), value in zip(waiting, np.add.reduceat(logs, starts), strict=True):
                    out[i] += float(value)
                waiting.clear()

        for i, text in enumerate(texts_):
            for x in contexts(text):
                waiting.append((i, x))
                size += len(x)
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out


class Model(Scorer):
    """Weights and estimates: direct for depths 0 and 1, sorted keys from 2. A depth without values has no nodes."""

    def __init__(self, shallow: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keys: dict[int, np.ndarray], values: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.shallow, self.keys, self.values = shallow, keys, values or {}

    def evaluate(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(byte | bytes before) of distinct codes."""
        byte = (codes & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(codes))
        for level in range(8):
            prefix = (1 << level) | (byte >> (8 - level))
            p = np.full(len(codes), 0.5)
            for depth in range(DEPTH, -1, -1):
                keys = ((codes >> np.uint64(8 * (DEPTH - depth + 1))).astype(np.int64) << 8) | prefix
                if depth < 2:
                    seen, own, kt = (x[keys] for x in self.shallow[depth])
                elif depth in self.values and len(self.keys[depth]):
                    at = np.minimum(np.searchsorted(self.keys[depth], keys), len(self.keys[depth]) - 1)
                    seen = self.keys[depth][at] == keys
                    own, kt = (x[at] for x in self.values[depth])
                else:
                    continue
                p = np.where(seen, own * kt + (1 - own) * p, p)
            out += np.log10(np.where((byte >> (7 - level)) & 1, p, 1 - p))
        return out


class Answers(Scorer):
    """Log probabilities of a chunk's codes."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.answers = codes[order], logs[order]

    def evaluate(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        if not (self.codes[at] == codes).all():
            raise ValueError("a code without an answer")
        return self.answers[at]


def shallow_of(up: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 0 and 1 from depth 1: keys (byte << 8 | prefix), counts, and sums of log P_w of depth 2."""
    shallow = []
    for size in (1 << 16, 1 << 8):
        z, o, b = (np.bincount(up, x, size) for x in (zeros, ones, below))
        pw, own, kt = weighted(z, o, b)
        shallow.append((z + o > 0, own, kt))
        up, zeros, ones, below = np.arange(size) & 255, z, o, np.where(z + o > 0, pw, 0.0)
    return shallow[::-1]


ANSWERS = "chunk long, pair int, size long, codes binary, logs binary"


def answered(batches: Iterator[pa.RecordBatch], shallow: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Packed log probabilities of the rows with a chunk. Rows are sorted by pair, counted ones (without a chunk) first."""
    counted, size, asked, n, model, now = [], 0, [], 0, None, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal counted, asked, n, model
        if not asked:
            return
        if model is None:  # whatever is asked, its pair's counts are all here
            nodes = list(built(*(np.concatenate(x) for x in zip(_no_codes(), *counted, strict=True))))
            model = Model(shallow, {d: keys for d, keys, *_ in nodes}, {d: values[1:] for d, _, _, _, values in nodes})
            counted = []
        distinct, back = np.unique(np.concatenate([codes for *_, codes in asked]), return_inverse=True)
        logs = model.evaluate(distinct)[back].view(np.uint64)
        ends = np.cumsum([0, *(len(codes) for *_, codes in asked)]).tolist()
        chunk, pair, blob, _ = zip(*asked, strict=True)
        yield batch_of(
            ANSWERS,
            len(asked),
            chunk=pa.array(chunk, pa.int64()),
            pair=pa.array(pair, pa.int32()),
            size=pa.array(np.diff(ends)),
            codes=pa.array(blob, pa.binary()),
            logs=pa.array([packed(logs[a:b]) for a, b in pairwise(ends)], pa.binary()),
        )
        asked, n = [], 0

    for batch in pieces(batches):
        chunks, blobs = batch.column("chunk").to_pylist(), batch.column("codes").to_pylist()
        for chunk, blob, (pair, codes, counts) in zip(chunks, blobs, unpacked_rows(batch, "counts"), strict=True):
            if chunk is None:
                if pair != now and (model is not None or size >= PART):
                    yield from flush()
                    counted, size, model = [], 0, None
                counted.append((codes, counts.astype(np.int64)))
                size += len(codes)
            else:
                asked.append((chunk, pair, blob, codes))
                n += len(codes)
                if n >= ASKED:
                    yield from flush()
            now = pair
    yield from flush()


class Trained:
    """The written counts (packed rows) of all training sequences, and depths 0 and 1."""

    def __init__(self, grams: DataFrame) -> None:
        self.grams = grams
        self.parts = max(2 * grams.sparkSession.sparkContext.defaultParallelism, codes_in(grams) // PART + 1)
        top = grams.repartition(self.parts, "pair").sortWithinPartitions("pair").mapInArrow(tops, TOP_SCHEMA)
        top = top.groupBy("up").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "pw"))).toArrow()
        self.shallow = shallow_of(*(top.column(c).to_numpy() for c in ("up", "zeros", "ones", "pw")))

    def answers(self, wanted: DataFrame) -> DataFrame:
        """Packed rows with logs for packed rows (chunk, pair, size, codes)."""
        shared = wanted.sparkSession.sparkContext.broadcast(self.shallow)
        rows = self.grams.select(F.lit(None).cast("long").alias("chunk"), "pair", "size", "codes", "counts")
        rows = rows.unionAll(wanted.select("chunk", "pair", "size", "codes", F.lit(None).cast("binary").alias("counts")))
        rows = rows.repartition(self.parts, "pair").sortWithinPartitions("pair", F.col("chunk").isNotNull())
        return rows.mapInArrow(lambda batches: answered(batches, shared.value), ANSWERS)

    def evaluate(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of distinct codes."""
        rows = packed_rows("chunk long, pair int, size long, codes binary", np.sort(codes), chunk=0).to_pylist()
        rows = self.grams.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "chunk long, pair int, size long, codes binary")
        found = {}
        for batch in self.answers(rows).toArrow().to_batches():
            for _, known, logs in unpacked_rows(batch, "logs"):
                found |= zip(known.tolist(), logs.view(np.float64).tolist(), strict=True)
        return np.array([found[int(x)] for x in codes])


def codes_in(rows: DataFrame) -> int:
    """Codes in packed rows."""
    return rows.agg(F.sum("size")).first()[0] or 0


# -- scoring ----------------------------------------------------------------


def head_of(counts: DataFrame, head: int = HEAD) -> tuple[int, int, dict[bytes, int]]:
    """(all training tokens, distinct ones, the most frequent ones with their counts).

    The least count is found from counts of counts by eighths of powers of two, so nothing is sorted.
    """
    short = F.when(F.length("token") <= HEAD_BYTES, 1).otherwise(0)
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(short).alias("short"), F.min("n").alias("least")
    ).collect()
    room, least = head, None
    for row in sorted(steps, key=lambda r: -r.step):
        room -= row.short
        if room < 0:
            break
        least = row.least
    rows = [] if least is None else counts.where((F.col("n") >= least) & (short == 1)).toArrow().to_pylist()
    return sum(r.n for r in steps), sum(r.v for r in steps), {bytes(r["token"]): r["n"] for r in rows}


def learned(chunks: DataFrame) -> tuple[DataFrame, Trained]:
    """Token counts (token, n) of training documents, and the model, from written CHUNKED."""
    counts = materialize(chunks.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    codes = chunks.where("pair is not null").select("pair", "size", "codes", "counts")
    parts = max(2 * chunks.sparkSession.sparkContext.defaultParallelism, codes_in(codes) // SUMMED + 1)
    grams = materialize(codes.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(summed, GRAMS), "grams", **WRITTEN)
    return counts, Trained(grams)


def train(docs: DataFrame) -> tuple[DataFrame, Trained]:
    """Token counts and the model of documents."""
    return learned(materialize(chunked(docs, CHUNK_MB), "chunks", **WRITTEN))


def same_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the chunk changes, and where its answers end and its texts begin."""
    for batch in batches:
        chunk, text = column(batch, "chunk"), batch.column("key").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((chunk[1:] != chunk[:-1]) | (text[1:] != text[:-1])) + 1
        for a, b in pairwise([0, *edges.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, tail array<struct<token: binary, times: long>>"


def scored_texts(key: int, doc_ids: list[int | None], bodies: list[bytes], model: Scorer, logs: dict[bytes, float]) -> pa.RecordBatch:
    """SCORED of texts with keys from ``key`` on; tail: the tokens that logs doesn't have."""
    rows, tokens, times, ends = [], [], [], [0]
    for key, doc_id, text, log10 in zip(count(key), doc_ids, bodies, model.scores(bodies)):
        own = Counter(text.translate(LOWER).split())
        own[END] += 1
        n, known, base = own.total(), 0, 0.0
        for token, times_ in own.items():
            if (log := logs.get(token)) is not None:
                known += times_
                base += times_ * log
            else:
                tokens.append(token)
                times.append(times_)
        ends.append(len(tokens))
        rows.append((key, doc_id, held_out(doc_id), n, known, base, log10, len(text)))
    tail = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "times"])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = ["key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "tail"]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)], names)


def score(docs: DataFrame, head: int = HEAD, chunk_mb: float = CHUNK_MB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: a row for each of docs."""
    spark = docs.sparkSession
    chunks = materialize(chunked(docs, chunk_mb), "chunks", **WRITTEN)
    counts, model = learned(chunks)
    total, distinct, common = head_of(counts, head)
    shared = spark.sparkContext.broadcast(common)
    bodies_of = chunks.where("key is not null").select("chunk", "pair", "size", "codes", F.lit(None).cast("binary").alias("logs"), "key", "texts")
    answers = model.answers(chunks.where("pair is not null"))
    answers = answers.select("chunk", "pair", "size", "codes", "logs", F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("texts"))
    parts = max(2 * spark.sparkContext.defaultParallelism, 4 * chunks.agg(F.count_distinct("chunk")).first()[0])
    together = answers.unionAll(bodies_of).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        logs = {token: math.log10(n + 0.5) for token, n in common.items()}
        now, codes, values, model = None, [], [], None
        for batch in same_chunk(batches):
            if batch.column("chunk")[0].as_py() != now:
                now, codes, values, model = batch.column("chunk")[0].as_py(), [], [], None
            if batch.column("key").null_count:
                for _, found, log in unpacked_rows(batch, "logs"):
                    codes.append(found)
                    values.append(log.view(np.float64))
                continue
            if model is None:
                model = Answers(np.concatenate([_no_codes()[0], *codes]), np.concatenate([np.empty(0), *values]))
                codes, values = [], []
            for first, blob in zip(batch.column("key").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                yield scored_texts(first, *decompressed(blob), model, logs)

    scored = materialize(together.mapInArrow(run, SCORED), "scored")
    done_with(chunks)
    tail = scored.select("key", F.explode("tail").alias("t")).select("key", "t.token", "t.times")
    tail = tail.join(counts, "token", "left").groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
    )
    return scored.drop("tail").join(tail, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))
        ).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
