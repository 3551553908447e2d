import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import packing as p

JSON = str(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@given(st.integers(1, 6000))
def test_cuts_cover_each_id_once(total):
    at = 0
    for start, length in p.cuts(total):
        assert start == at and 0 < length <= p.CAPACITY
        at += length
    assert at == total
    assert len(p.cuts(total)) <= total // p.CAPACITY + p.CUTS


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    slow, fast = p.encoders(JSON, RANKS)
    want = Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids if len(text) < 20 else slow.encode(text, add_special_tokens=False).ids
    assert p.token_ids(text, slow, fast).tolist() == want


def test_special_token_in_a_text_and_real_texts(spark, sf):
    slow, fast = p.encoders(JSON, RANKS)
    assert 50256 in p.token_ids("a<|endoftext|>b", slow, fast).tolist()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert p.token_ids(r.text, slow, fast).tolist() == slow.encode(r.text, add_special_tokens=False).ids


def rebuilt(rows, texts):
    """Check every promise of the result against the ids themselves."""
    slow, _ = p.encoders(JSON, None)
    ids = {d: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[d][r.start : at].tobytes())
        assert at == len(ids[d])
    sizes = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= p.CAPACITY
        sizes.append(at)
    padding = sum(0 if n & (n - 1) == 0 else p.CAPACITY - n for n in sizes)
    return padding / (padding + sum(sizes))


def test_pack_is_an_exact_round_trip_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding = rebuilt(p.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "word " * 30000, 7)], "doc_id long, text string, length int")
    rows = p.pack(docs).collect()
    rebuilt(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert p.pack(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(4, "a"), (4, "a"), (None, "b")], "doc_id long, text string")
    assert len(p.pack(twice).collect()) == 3


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 11, 15, 16, 17, 341, 342, 512, 513, 1024])
def test_classes_are_reciprocal(length):
    k = p.size_class(length)
    assert k * length <= p.CAPACITY < (k + 1) * length


@pytest.mark.parametrize("length", [1, 3, 5, 7, 11, 13, 16, 20, 40])
def test_documents_of_one_short_length_leave_little_padding(length):
    packer, rows = p.Packer(0), []
    for i in range(32_000):
        for start, size in p.cuts(length):
            rows += packer.add((i, start, size, 0, length))
    rows += packer.end()
    bins = {r[5] for r in rows}
    assert sum(r[2] for r in rows) == 32_000 * length
    assert 1 - 32_000 * length / (p.CAPACITY * len(bins)) < 0.05


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 1024), st.integers(1, 40)), max_size=3000), st.sampled_from([64, 1000, 1024]))
def test_bins_hold_what_their_class_says(lengths, capacity):
    """Brute force: while pieces come, each class's k pieces in their order are a bin; the rest fits into few bins at the end."""
    packer, filled = p.Packer(3, capacity), []
    lengths = [min(x, capacity) for x in lengths]
    for i, n in enumerate(lengths):
        if rows := packer.add((i, 0, n, 0, n)):
            filled.append([r[0] for r in rows])
    by_class, want, rest = defaultdict(list), [], set(range(len(lengths)))
    for i, n in enumerate(lengths):
        own = by_class[capacity // n]
        own.append(i)
        if len(own) == capacity // n:
            want.append(list(own))
            rest -= set(own)
            own.clear()
    assert filled == want
    left = packer.end()
    assert {r[0] for r in left} == rest
    sizes = defaultdict(int)
    for r in left:
        assert r[6] == sizes[r[5]]
        sizes[r[5]] += r[2]
    assert all(n <= capacity for n in sizes.values())
    assert sum(n <= capacity // 2 for n in sizes.values()) <= 1
