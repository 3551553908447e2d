import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import chunking as c

TEXT = st.text(alphabet="ab .\n", max_size=300)


def test_merged_lines_by_hand():
    assert c.merged_lines("\na\nbb\n\nccc", 5) == ["a\nbb\n", "ccc"]


def test_blank_line_may_open_a_batch_after_a_full_one():
    assert c.merged_lines("aaaaa\n\nb", 5) == ["aaaaa", "\nb"]
    assert c.merged_lines("aaaaa\n", 5) == ["aaaaa", ""]


def test_merged_paragraphs_by_hand():
    assert c.merged_paragraphs("a\n\n\n\nb\n\nc", 4) == ["a\n\nb", "c"]
    assert c.merged_paragraphs("a\n\n" + "x" * 9 + "\n\nb", 4) == ["a", "xxxx", "xxxx", "x", "b"]


def test_recursive_keeps_separators_and_overlap():
    assert c.recursive("aa bb cc dd", 6, 0) == ["aa bb", "cc dd"]
    pieces = c.recursive("one two three four five six", 12, 6)
    assert pieces[0] == "one two" and "two" in pieces[1]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(4, 40), st.integers(0, 3))
def test_recursive_properties(text, size, overlap):
    pieces = c.recursive(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert all(p in text for p in pieces)
    assert {x for p in pieces for x in p if not x.isspace()} == {x for x in text if not x.isspace()}
    if overlap == 0:
        kept = "".join("".join(p.split()) for p in pieces)
        assert kept == "".join(text.split())


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(4, 40))
def test_merges_lose_nothing(text, size):
    for merged in (c.merged_lines, c.merged_paragraphs):
        assert "".join("".join(p.split()) for p in merged(text, size)) == "".join(text.split())


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(8, 60))
def test_merged_paragraphs_equal_brute_force(text, size):
    """Paragraphs one by one: a batch goes on as long as the joined text fits."""
    want, batch = [], []
    for part in filter(None, (p.strip() for p in text.split("\n\n"))):
        if len("\n\n".join([*batch, part])) <= size:
            batch.append(part)
            continue
        if batch:
            want.append("\n\n".join(batch))
        if len(part) > size:
            want += c.recursive(part, size, 0)
            batch = []
        else:
            batch = [part]
    assert c.merged_paragraphs(text, size) == want + (["\n\n".join(batch)] if batch else [])


def test_legal_markers_come_first():
    text = "x" * 30 + "\nArticle 1 " + "y" * 30
    assert c.recursive(text, 45, 0, c.LEGAL_SEPARATORS) == ["x" * 30, "Article 1 " + "y" * 30]


def test_by_character_splits_what_is_too_long():
    assert all(len(x) <= 20 for x in c.by_character("a" * 50 + "\n\nb", 20, 3))


def test_registry():
    assert len(c.SPECS) == 10
    with pytest.raises(ValueError):
        c.register("line_n_merge", c.merged_lines, 5)
    with pytest.raises(ValueError):
        c.specs(["nope"])


def test_chunk_and_uid(spark):
    docs = spark.createDataFrame([("a", "one\ntwo", 1), ("b", None, 2), ("c", "", 3)], "doc_id string, text string, pos int").drop("pos")
    rows = c.chunk(docs, ["line_n_merge"]).collect()
    assert [(r.doc_id, r.pos, r.text) for r in rows] == [("a", 0, "one\ntwo")]
    assert rows[0].chunk_uid == hashlib.sha256(b"a|line_n_merge|0").hexdigest()[:32]
    with pytest.raises(ValueError):
        c.chunk(docs.drop("text"), ["line_n_merge"])


def test_global_index(spark):
    rows = spark.createDataFrame([(i * 7 % 50, 0) for i in range(50)], "doc_id int, pos int").repartition(5)
    out = {r.doc_id: r.idx for r in c.global_index(rows, "doc_id", "pos").collect()}
    assert out == {i: i for i in range(50)}
