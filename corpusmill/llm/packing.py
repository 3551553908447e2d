"""Harmonic packing of tokenized documents into sequences of at most 1024 ids.

A document's ids (with the separating id 0 at its end) are cut into full
sequences and a remainder. The remainder is cut at reciprocals of the
capacity, ``capacity // k``, into at most ``CUTS`` pieces. A piece of length
in (capacity/(k+1), capacity/k] has class k, and a bin of class k holds
exactly k pieces, for every k up to the capacity itself, so a bin of class k is filled to more than k/(k + 1). Each worker fills its own bins; sequence ids carry the
worker's partition number, so workers need not agree on anything. At its end a
worker packs the pieces of its unfilled bins together, longest first.

A worker holds one unfilled bin for each class, a few thousand pieces at most, so its memory doesn't grow with the input.
Null and empty texts are the single id 0, an empty table has no rows, a very long text is packed whole. Repeated rows are packed as often as
they occur, ties go by input order, and columns other than doc_id and text are not read. Tokens of ``<|endoftext|>`` in a text get its id, as the tokenizer
does by default.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusmill.llm.common import pieces, strings, texts

CAPACITY = 1024
#: A remainder of at most this many ids isn't cut further.
SMALL = 16
CUTS = 3

#: Texts of these characters alone get the same ids from the vocabulary's rank file, several times as fast.
COMMON = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u20ac]|<\\|endoftext\\|>")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def encoders(json_file: str, rank_file: str | None):
    """The tokenizer of a file, and a faster one of the same vocabulary; once per worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_file)
    if rank_file is None:
        return slow, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return slow, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, slow, fast) -> np.ndarray:
    """uint32 ids as Tokenizer.encode(text, add_special_tokens=False) gives them."""
    if fast is None or COMMON.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text).astype(np.uint32, copy=False)


def size_class(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length a bin holds."""
    return capacity // length


def cuts(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then reciprocals of the capacity, then the rest."""
    out = [(at, capacity) for at in range(0, total - capacity + 1, capacity)]
    at, left = len(out) * capacity, total % capacity
    for _ in range(CUTS - 1):
        if left <= SMALL:
            break
        k = -(-capacity // left)
        length = capacity // k
        if length < left:
            out.append((at, length))
            at, left = at + length, left - length
        else:
            break
    if left:
        out.append((at, left))
    return out


class Packer:
    """Bins of one worker; ``numbers`` gives sequence ids."""

    def __init__(self, worker: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces_: list[tuple]) -> list[tuple]:
        number, offset, rows = self.next, 0, []
        self.next += 1
        for piece in pieces_:
            rows.append((*piece, number, offset))
            offset += piece[2]
        return rows

    def add(self, piece: tuple) -> list[tuple]:
        """Rows of the bin that this piece fills, if it does. A piece: doc_id, start, length, crc, doc_tokens."""
        k = size_class(piece[2], self.capacity)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        return self.close(bin_)

    def end(self) -> list[tuple]:
        """First-fit decreasing over what the unfilled bins hold, at most a bin's content less a piece for each class."""
        bins: list[tuple[int, list]] = []
        for piece in sorted((x for b in self.open.values() for x in b), key=lambda x: -x[2]):
            for at, (room, held) in enumerate(bins):
                if piece[2] <= room:
                    held.append(piece)
                    bins[at] = (room - piece[2], held)
                    break
            else:
                bins.append((self.capacity - piece[2], [piece]))
        self.open = {}
        return [row for _, held in bins for row in self.close(held)]


def pack(docs: DataFrame, json_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece. ``json_file``: a tokenizers file; by default the public byte-level BPE of 50k."""
    import public_tokenizers

    rank_file = None
    if json_file is None:
        json_file, rank_file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    json_file, rank_file = str(json_file), rank_file and str(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast = encoders(json_file, rank_file)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = np.append(token_ids(text, slow, fast), np.uint32(0))
                data = memoryview(ids.astype("<u4")).cast("B")
                for start, length in cuts(len(ids), capacity):
                    rows += packer.add((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(ids)))
            if rows:
                yield _rows(rows)
        if rows := packer.end():
            yield _rows(rows)

    return texts(docs).mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
