import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import decontaminate as dc

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(5000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = {i: words(n) for i, n in enumerate([60, 40, 25, 14, 9, 8])}


@pytest.fixture(scope="module")
def index():
    return dc.Index([(i, " ".join(w).encode()) for i, w in ITEMS.items()])


def test_exact_passages_are_found(index):
    for i, item in ITEMS.items():
        text = " ".join(words(200) + item + words(200)).upper().encode()
        assert [(r[0], r[1], r[2], r[3], r[4]) for r in index.overlaps(text)] == [(i, 200, 0, len(item), len(item))]


@pytest.mark.parametrize("every", [8, 10])
def test_substituted_passages_are_found(index, every):
    for i in (0, 1):
        item = [w if k % every else f"other{k}" for k, w in enumerate(ITEMS[i])]
        assert [r[0] for r in index.overlaps(" ".join(words(50) + item + words(50)).encode())] == [i]


def test_parts_and_clean_texts(index):
    assert [r[0] for r in index.overlaps(" ".join(words(30) + ITEMS[0][10:40]).encode())] == [0]
    assert index.overlaps(" ".join(words(5000)).encode()) == []
    assert index.overlaps(" ".join(ITEMS[0][:9] + words(100)).encode()) == []
    assert index.overlaps(b"") == []


@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_segment_is_the_largest_sum(same):
    first, last = dc.segment(__import__("numpy").array(same))
    value = lambda a, b: sum(1 if x else -2 for x in same[a:b])
    assert value(first, last) == max(0, max(value(a, b) for a in range(len(same)) for b in range(a, len(same) + 1)))


def test_hits_equal_brute_force(index):
    """A window with equal kept words is a hit, and no other is."""
    text = words(40) + ITEMS[1][5:30] + words(10) + ITEMS[2]
    known = __import__("numpy").array([index.vocabulary.get(w.encode(), 0) for w in text])
    got = {tuple(x) for x in index.diagonals(known).tolist()}
    want = set()
    for mask, those in index.masks.items():
        kept = [k for k, x in enumerate(mask) if x == "1"]
        for i in those:
            item = ITEMS[i]
            for a in range(len(item) - len(mask) + 1):
                for b in range(len(text) - len(mask) + 1):
                    if all(item[a + k] == text[b + k] for k in kept):
                        want.add((i, b - a))
    assert got == want


def test_operator_blocks_and_edges(spark):
    docs = spark.createDataFrame([(1, " ".join(words(20) + ITEMS[0])), (1, " ".join(ITEMS[0])), (2, None), (3, ""), (None, " ".join(ITEMS[2])), (5, "clean " * 20000)], "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in ITEMS.items()), (70, None), (None, " ".join(ITEMS[2])), (71, "too short")], "item_id long, text string")
    whole = sorted(map(str, dc.overlaps(docs, bench).collect()))
    assert len(whole) == 4 and sorted(map(str, dc.overlaps(docs, bench, block_mb=0.0002).collect())) == whole
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == [2, 3, 5]
    assert sorted(r.doc_id for r in dc.clean(docs, bench, block_mb=0.0002).collect()) == [2, 3, 5]
    assert dc.overlaps(docs.where("false"), bench).count() == 0 and dc.overlaps(docs, bench.where("false")).count() == 0


def damaged(item, n, times):
    """Every text with n words of the item of which ``times`` are others, and nothing else of it."""
    for start in {0, (len(item) - n) // 2, len(item) - n}:
        for others in itertools.combinations(range(n), times):
            yield " ".join(["a", "b", *("other" if k in others else w for k, w in enumerate(item[start : start + n])), "c", "d"]).encode()


@pytest.mark.parametrize("n", range(8, 16))
def test_every_overlap_with_a_short_item_is_found(n):
    item = [f"s{k}" for k in range(n)]
    index = dc.Index([(1, " ".join(item).encode())])
    for part in range(-(-4 * n // 5), n + 1):
        for text in damaged(item, part, part // 5):
            assert [r[0] for r in index.overlaps(text)] == [1], text
    assert index.overlaps(" ".join(item[: n // 2]).encode()) == []


@pytest.mark.parametrize("n", range(1, 8))
def test_fewer_words_are_found_verbatim(n):
    item = [f"s{k}" for k in range(n)]
    index = dc.Index([(1, " ".join(item).encode()), (2, b" . ")])
    assert index.overlaps(" ".join(["a", *item, "b"]).encode()) == [(1, 1, 0, n, n, 1.0)]
    assert index.overlaps(" ".join([*item[:-1], "b"]).encode()) == []


@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_longest_segment(same):
    first, last = dc.longest(__import__("numpy").array(same))
    good = [b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
    assert last - first == max(good, default=0) and 5 * sum(same[first:last]) >= 4 * (last - first)


@pytest.mark.parametrize("n", [*range(13, 26)])
def test_masks_are_lossless(n):
    """A longer segment has one of 13 to 25 words with the same share of equal words."""
    kept = [sum(1 << at + k for k, x in enumerate(mask) if x == "1") for mask in dc.MASKS for at in range(n - len(mask) + 1)]
    for others in itertools.combinations(range(n), n // 5):
        gone = sum(1 << k for k in others)
        assert any(not gone & x for x in kept), others


@pytest.mark.parametrize("n", [13, 15, 16, 20])
def test_every_overlap_with_a_long_item_is_found(n):
    item = [f"s{k}" for k in range(n)]
    whole, part = (dc.Index([(1, " ".join(x).encode())]) for x in (item, [*words(20), *item, *words(20)]))
    for text in damaged(item, n, n // 5):
        assert [r[0] for r in whole.overlaps(text)] == [1], text
        assert [r[0] for r in part.overlaps(text)] == [1], text


def test_clashing_columns_ties_and_repeated_rows(spark):
    passage = " ".join(ITEMS[1])
    docs = spark.createDataFrame([(1, f"{passage} between {passage}", 9, 9.0), (1, f"{passage} between {passage}", 9, 9.0), (2, "nothing of it here", 9, 9.0)], "doc_id long, text string, item_id int, similarity double")
    items = spark.createDataFrame([(5, passage, 1), (5, passage, 1), (6, passage, 1), (None, passage, 1)], "item_id long, text string, doc_id int")
    rows = sorted((tuple(r) for r in dc.overlaps(docs, items).collect()), key=str)
    one = [(1, i, 0, 0, 40, 40, 1.0) for i in (5, 6, None)]  # of two equal overlaps the first, of two equal items one
    assert rows == sorted(one * 2, key=str)
    assert [r.doc_id for r in dc.clean(docs.select("doc_id", "text"), items).collect()] == [2]
    assert dc.overlaps(docs, items.where("false")).count() == dc.overlaps(docs.where("false"), items).count() == 0
