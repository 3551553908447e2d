import numpy as np
import pytest
import xxhash

from corpusmill.llm import simhash as s

M = (1 << 64) - 1


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Union-find over all pairs; fps: doc_id -> fingerprint."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def planted(n=400, seed=1):
    """Clusters within a few bits, chains, and strangers."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            base ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5)))
            out.append(base & M)
    return out + [int(x) for x in rng.integers(0, 1 << 63, n - len(out))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b", "A b C d e", "é É a\x0bb\x1cc " * 30, "x " * 500])
def test_fingerprint_is_brute_force(text):
    assert s.fingerprint(text.encode()) == brute_fingerprint(text)


def test_spark_xxhash_agrees(spark):
    text = "one two three"
    got = spark.sql(f"select xxhash64('{text}')").first()[0] & M
    assert got == xxhash.xxh64_intdigest(text.encode(), 42)


def test_gray_rank_inverts_the_gray_code():
    x = np.arange(4096, dtype=np.uint64)
    assert (s.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_index_finds_all_pairs():
    x = np.unique(np.array(planted(1500, 3), np.uint64))
    x = x[np.argsort(s.gray_rank(x))]
    index = s.GrayIndex(x)
    got = set()
    for first in range(0, len(x), s.BLOCK):
        i, j = index.search(x[first : first + s.BLOCK], first)
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


@pytest.mark.parametrize("group", [s.GROUP, 16])
def test_components_equal_brute_force_with_and_without_splitting(spark, group):
    values = planted()
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(values))], "fp long")
    roots = {r.node & M: r.root & M for r in s.components(s.links(nodes, group)).collect()}
    want = brute_components(dict(enumerate(sorted(set(values)))))
    order = sorted(set(values))
    same = {}
    for i, c in want.items():
        same.setdefault(c, set()).add(order[i])
    got = {}
    for v in order:
        got.setdefault(roots.get(v, v), set()).add(v)
    assert set(map(frozenset, same.values())) == set(map(frozenset, got.values()))


def test_documents_equal_brute_force(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 4
    texts = [(1, body), (2, body), (3, body.upper()), (4, body + "end"), (5, ""), (6, None), (7, "\t"), (8, "one"), (8, "one"), (None, body), (9, "other words here")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, fp string, component_id int")
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in s.op5(docs).collect()]
    assert len(rows) == len(texts)
    fps = {i: brute_fingerprint(t or "") for i, t in texts if i is not None}
    want = brute_components(fps)
    assert {r for r in rows if r[0] is not None} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert [r for r in rows if r[0] is None] == [(None, f"{fps[1]:016x}", 1)]


def test_a_component_without_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "only nulls")], "doc_id long, text string")
    assert s.op5(docs).first().component_id is None
    assert s.op5(docs.where("false")).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    docs = spark.createDataFrame([(3, long), (2, long), (7, long + " end"), (9, "short and different")], "doc_id long, text string")
    rows = {r.doc_id: r for r in s.op5(docs).collect()}
    assert rows[3].fingerprint == rows[2].fingerprint == f"{brute_fingerprint(long):016x}"
    assert [rows[i].component_id for i in (3, 2, 7, 9)] == [2, 2, 2, 9]
