import numpy as np
import pytest

from corpusmill.llm import neighbours as nb


def brute(rows, k):
    """query -> [(vec_id, score)]; rows: distinct vec_id -> vector."""
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard", [50, 4096])
def test_factor_one_is_exact(spark, shard):
    x = np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32)
    rows = {i: v.tolist() for i, v in enumerate(x)}
    want = brute(rows, 20)
    got = {}
    for r in nb.nearest(frame(spark, rows), factor=1.0, shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in v], abs=1e-12)


@pytest.mark.parametrize("clusters", [0, 30])
def test_recall_at_the_production_factor(clusters):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)) if not clusters else rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 4000)] + 0.25 * rng.normal(size=(4000, 64))
    q = x[::20]
    norms = (x**2).sum(axis=1)
    tree = nb.Tree(np.c_[x, np.sqrt(np.maximum(0, norms.max() - norms))])
    found, _ = tree.search(np.c_[q, np.zeros(len(q))], 20, nb.FACTOR)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), true.tolist(), strict=True)])
    assert recall >= 0.95


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_of_the_operator_at_the_production_factor(spark, kind):
    """Many shards in a task, whose lists bound each other's searches, against all inner products."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    if kind == "clusters":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 20_000)] + 0.25 * x
    x *= rng.uniform(0.5, 2, (20_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 200 = 0")
    got = {}
    for r in nb.nearest(df, asked, shard=1000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 20_000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.95


def test_recall_on_the_given_table(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in df.collect()), strict=True)
    ids, x = np.array(ids), np.array(x)
    got = {}
    for r in nb.nearest(df, shard=256).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = []
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(got[q] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.95


def test_blocks_of_queries_give_the_same(spark):
    x = np.random.default_rng(6).normal(size=(500, 4))
    df = spark.createDataFrame([(i, v.tolist(), i, i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, query_id int")
    one, many = (sorted(map(tuple, nb.nearest(df, factor=1.0, shard=64, block_mb=b).collect())) for b in (16, 0.0003))
    assert one == many and len(one) == 25 * 20


def test_larger_factors_compare_less():
    x = np.random.default_rng(3).normal(size=(3000, 4))
    points = np.c_[x, np.zeros(len(x))]
    work = [nb.Tree(points).search(points[:50], 5, f)[1] for f in (1, 2, 8)]
    assert work[0] > work[1] > work[2]


def test_copies_ties_and_invalid_rows(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(100)] + [(200, [2.0, 0.0]), (201, None), (202, []), (203, [0.0, 0.0]), (204, [1.0, None]), (205, [float("nan"), 1.0]), (220, [float("inf"), 1.0]), (None, same), (240, [1.0, 1.0, 1.0]), (241, [1.0, 0.0, 0.0]), (60, same)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    out = {}
    for r in nb.nearest(df, factor=1.0, shard=16).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert set(out) == {0, 20, 40, 60, 80, 200, 240}
    assert out[0] == [200, *range(1, 20)] and out[20] == [200, *range(19)]
    assert out[200] == list(range(20)) and out[240] == [241]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nb.nearest(df).count() == 0
