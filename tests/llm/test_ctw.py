import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = Counter()
        self.children = {}
        for text in texts:
            data = bytes(ctw.DEPTH) + text
            for i in range(ctw.DEPTH, len(data)):
                for level in range(8):
                    prefix, bit = (1 << level) | (data[i] >> (8 - level)), data[i] >> (7 - level) & 1
                    for d in range(ctw.DEPTH + 1):
                        context = bytes(reversed(data[i - d : i]))
                        self.counts[context, prefix, bit] += 1
                        if d:
                            self.children.setdefault((context[:-1], prefix), set()).add(context)
        self.memo = {}

    def pw(self, context, prefix):
        if (context, prefix) not in self.memo:
            pe = kt(self.counts[context, prefix, 0], self.counts[context, prefix, 1])
            if len(context) < ctw.DEPTH:
                below = sum(self.pw(c, prefix) for c in self.children.get((context, prefix), ()))
                pe = np.logaddexp(pe, below) - math.log(2)
            self.memo[context, prefix] = pe
        return self.memo[context, prefix]

    def p(self, past, prefix, depth=0):
        context = past[:depth]
        a, b = self.counts[context, prefix, 0], self.counts[context, prefix, 1]
        if a + b == 0:
            return 0.5
        own = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH:
            return own
        w = math.exp(kt(a, b) - math.log(2) - self.pw(context, prefix))
        return w * own + (1 - w) * self.p(past, prefix, depth + 1)

    def score(self, text):
        data, out = bytes(ctw.DEPTH) + text, 0.0
        for i in range(ctw.DEPTH, len(data)):
            past = bytes(reversed(data[i - ctw.DEPTH : i]))
            for level in range(8):
                p = self.p(past, (1 << level) | (data[i] >> (8 - level)))
                out += math.log10(p if data[i] >> (7 - level) & 1 else 1 - p)
        return out


TEXTS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat", "THE cat", "élan", "", None, "a b a b a b", "cat\tcat\ncat", "zebra", "the mat"] * 2)]


def test_base_and_model_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, score string, n long")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in TEXTS}
    counts, brute = Counter(), Brute([(t or "").encode() for i, t in TEXTS if not held[i]])
    tokens = lambda t: [w.encode() for w in (t or "").lower().split()] + [b""]
    for i, t in TEXTS:
        if not held[i]:
            counts.update(tokens(t))
    n, v = counts.total(), len(counts)
    for head in (ctw.HEAD, 3, 0):
        rows = {r.doc_id: r for r in ctw.score(docs, head).collect()}
        assert len(rows) == len(TEXTS)
        for i, t in TEXTS:
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
            assert r.score == pytest.approx(brute.score((t or "").encode()), rel=0.02, abs=1e-3)  # weights and estimates are held in 24 bits


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "abracadabra abracadabra")], "doc_id long, text string")
    _, model = ctw.train(docs)
    for past in (b"abrac", b"zzzzz", b"\0\0\0\0\0"):
        code = int.from_bytes(past[::-1][: ctw.DEPTH], "big") << 8
        total = sum(10.0 ** model.evaluate(np.arange(code, code + 256, dtype=np.uint64)))
        assert total == pytest.approx(1)


def test_cache_and_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 105, 5000).astype(np.uint8))
    model = ctw.Model([(np.zeros(1 << 8, bool), np.ones(1 << 8), np.full(1 << 8, 0.5)), (np.zeros(1 << 16, bool), np.ones(1 << 16), np.full(1 << 16, 0.5))], {d: np.zeros(1 << ctw.SLOT_BITS, np.uint32) for d in range(2, ctw.DEPTH + 1)})
    assert model.scores([text, b"", text]) == pytest.approx([-8 * 5000 * math.log10(2), 0, -8 * 5000 * math.log10(2)])
    whole = np.concatenate(list(ctw.contexts(text)))
    monkeypatch.setattr(ctw, "CHUNK", 7)
    assert (np.concatenate(list(ctw.contexts(text))) == whole).all()


def test_log_gammas():
    n = np.array([0, 1, 2, 63, 64, 255, 256, 257, 1000, 10**6], float)
    assert ctw.log_gamma_half(n) == pytest.approx([math.lgamma(x + 0.5) for x in n])
    assert ctw.log_gamma(n) == pytest.approx([math.lgamma(x + 1) for x in n])


def test_learns(spark, sf):
    rows = ctw.score(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    held = [r for r in rows if r.held_out and r.bits_per_byte is not None]
    assert np.mean([r.bits_per_byte for r in held]) < 3.2


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(empty).count() == 0
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (4, None), (5, "long" * 50000)], "doc_id long, text string")
    rows = ctw.score(docs).collect()
    assert len(rows) == 5 and all(r.score <= 0 for r in rows)
    assert all(b - a >= 0 for a, b in pairwise(sorted(r.n_tokens for r in rows)))


def test_no_node_is_lost(spark):
    """Thousands of random contexts: of hashed tables, some would share a slot."""
    rng = np.random.default_rng(5)
    texts = {i: rng.integers(1, 128, 1500).astype(np.uint8).tobytes().decode() for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    brute = Brute([t.encode() for i, t in texts.items() if not ctw.held_out(i)])
    for chunk_mb in (ctw.CHUNK_MB, 0.001):
        rows = ctw.score(docs, chunk_mb=chunk_mb).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.score == pytest.approx(brute.score(texts[r.doc_id].encode()), rel=1e-9)


def test_rows_that_move_are_packed(spark):
    """A row for each pair of nearest bytes in a chunk, not for each sequence: memory of executors depends on it."""
    text = np.random.default_rng(3).integers(97, 113, 40_000).astype(np.uint8).tobytes()
    distinct = len(np.unique(np.concatenate(list(ctw.contexts(text)))))
    docs = spark.createDataFrame([(0, text.decode())], "doc_id long, text string").coalesce(1)
    assert ctw.chunked(docs, ctw.CHUNK_MB).where("key is null").count() < distinct / 50


def test_sizes_of_packed_rows_and_groups_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    trained, other = (rng.integers(97, 97 + n, 3000).astype(np.uint8).tobytes() for n in (4, 6))
    codes, counts = np.unique(np.concatenate(list(ctw.contexts(trained))), return_counts=True)
    wanted = {chunk: np.unique(np.concatenate(list(ctw.contexts(x)))) for chunk, x in enumerate((trained, other, b"q"))}
    schema = "chunk long, pair int, size long, codes binary, counts binary"

    def answers():
        unseen = np.setdiff1d(wanted[1], codes)
        part = [ctw.packed_rows(schema, codes, counts), ctw.packed_rows(schema, unseen, np.zeros(len(unseen), np.int64)), ctw.packed_rows(schema, codes, counts)]
        grams = pa.Table.from_batches(ctw.summed(pa.Table.from_batches(part).sort_by("pair").to_batches()))
        found = [x for batch in grams.to_batches() for x in ctw.unpacked_rows(batch, "counts")]
        assert max(len(x) for _, x, _ in found) <= ctw.BLOB
        assert (np.concatenate([x for _, x, _ in found]) == codes).all() and (np.concatenate([n for *_, n in found]) == 2 * counts).all()
        top = pa.Table.from_batches(ctw.tops(grams.to_batches()))
        shallow = ctw.shallow_of(*(top.column(c).to_numpy() for c in ("up", "zeros", "ones", "pw")))
        rows = [ctw.batch_of(schema, x.num_rows, **{c: x.column(c) for c in grams.column_names}) for x in grams.to_batches()]
        rows = pa.Table.from_batches([*rows, *(ctw.packed_rows(schema, x, chunk=chunk) for chunk, x in wanted.items())])
        rows = rows.sort_by([("pair", "ascending"), ("counts", "descending")])  # nulls, the asked ones, come last
        out = {}
        for batch in ctw.answered(rows.to_batches(), shallow):
            for chunk, (_, x, logs) in zip(batch.column("chunk").to_pylist(), ctw.unpacked_rows(batch, "logs"), strict=True):
                out |= {(chunk, int(c)): log for c, log in zip(x, logs.view(np.float64), strict=True)}
        return out

    whole = answers()
    assert whole.keys() == {(chunk, int(c)) for chunk, x in wanted.items() for c in x}
    brute = Brute([trained, trained])
    for chunk, text in enumerate((trained, other, b"q")):
        assert sum(whole[chunk, int(c)] for x in ctw.contexts(text) for c in x) == pytest.approx(brute.score(text), rel=1e-9)
    for blob, chunk, part, asked in ((3, 50, 40, 30), (1, 1, 1, 1), (7, 10**6, 200, 10**6)):
        for name, value in (("BLOB", blob), ("CHUNK", chunk), ("PART", part), ("ASKED", asked)):
            monkeypatch.setattr(ctw, name, value)
        found = answers()
        assert found.keys() == whole.keys() and all(found[k] == pytest.approx(whole[k], rel=1e-12) for k in whole)


def test_packed_numbers():
    for x in ([0], [255, 0, 256], [2**32 - 1, 5], [2**64 - 1, 0, 1]):
        x = np.array(x, np.uint64)
        assert (ctw.unpacked(ctw.packed(x), len(x)) == x).all()
    assert len(ctw.packed(np.array([255, 0], np.uint64))) == 2
