import re
import zlib

import pytest

import corpus_pipeline as cp
from corpusmill.llm import decontaminate, packing, simhash

ALL = "doc_id long, text string, lang string, source string, n_chars long, score double, key int"


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What each stage kept, by name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "pii", "pack"]


def test_language_keeps_what_has_a_letter(steps):
    want = {r.doc_id for r in steps["documents"] if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in steps["language"]} == want
    kept = {r.doc_id: r for r in steps["documents"]}
    assert all(kept[r.doc_id] == r for r in steps["language"])


def test_one_document_of_each_component_stays(steps):
    rows = steps["language"]
    fps = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in steps["near_duplicates"]) == sorted({find(i) for i in ids})


def test_documents_with_benchmark_passages_go(spark, sf, steps):
    index = next(decontaminate.blocks_of(spark.read.parquet(f"{sf}/benchmark.parquet")))
    want = {r.doc_id for r in steps["near_duplicates"] if not index.overlaps(r.text.encode())}
    assert {r.doc_id for r in steps["decontaminate"]} == want
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    for r in steps["decontaminate"]:
        body = f" {clean(r.text)} "
        assert not any(f" {clean(x)} " in body for x in items if len(clean(x).split()) >= decontaminate.LEAST)


def test_personal_data_is_masked_and_no_document_goes(steps):
    before, after = ({r.doc_id: r for r in steps[n]} for n in ("decontaminate", "pii"))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        assert r.text == before[i].text or (r.n_chars == len(r.text) and "[" in r.text)
        assert (r.lang, r.source) == (before[i].lang, before[i].source)


def test_every_token_is_in_one_piece(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    import numpy as np

    ids = {r.doc_id: np.array([*slow.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in steps["pii"]}
    at, used = dict.fromkeys(ids, 0), {}
    for r in sorted(steps["pack"], key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(parts[-1]) <= packing.CAPACITY


def test_edges(spark, sf):
    rows = [(1, None, "en", "s", 0, 0.0, 1), (2, "", None, "s", 0, 0.0, 1), (3, "alpha beta gamma delta", None, None, None, 0.0, 1), (4, "alpha beta gamma delta", "en", "s", 22, 0.0, 1), (5, "some wholly other words of a text", "en", "s", 33, 0.0, 1), (5, "some wholly other words of a text", "en", "s", 33, 0.0, 1), (None, "no id here at all", "en", "s", 17, 0.0, 1)]
    docs = spark.createDataFrame(rows, ALL)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == list(cp.COLUMNS), name
    assert sorted(r.doc_id for r in docs.collect()) == [3, 5]
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
        if empty.columns != list(cp.COLUMNS):
            break


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_near_duplicates_are_rows(spark, sf):
    """Rows without a doc_id, or with one that others have, go only as near duplicates."""
    body = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [
        (None, body("alone"), "en", "s", 1),
        (None, body("twice"), "en", "s", 1),
        (None, body("twice"), "en", "s", 1),
        (None, body("twice"), None, "s", 1),
        (7, body("first"), "en", "s", 1),
        (7, body("second"), "en", "s", 1),
        (7, body("copied"), "en", "s", 1),
        (6, body("copied"), "en", "s", 1),
        (None, body("copied"), "en", "s", 1),
        (8, body("same"), "en", "s", 1),
        (8, body("same"), "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, docs, sf).collect()), key=str)
    assert found == sorted([(0, body("alone")), (0, body("twice")), (7, body("first")), (7, body("second")), (6, body("copied")), (8, body("same"))], key=str)
    for _, stage in cp.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert sorted({r.doc_id or 0 for r in docs.collect()}) == [0, 6, 7, 8]


def test_very_long_texts_and_clashing_columns(spark, sf):
    long = " ".join(f"word{i % 977} und so weiter {i}" for i in range(20_000)) + " mail jane.doe@example.org now"
    rows = [(1, long, "en", "s", len(long), 0.5, 7), (2, "a short text of its own, with words", "en", "s", 35, 0.5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h1 double, times int")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == list(cp.COLUMNS), name
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == {1, 2} and kept[1].text.endswith(" mail [email] now") and kept[1].n_chars == len(kept[1].text)
    assert kept[1].text.startswith(long[:1000])
    sizes = {r.doc_id: r.doc_tokens for r in cp.pack(spark, docs, sf).collect()}
    assert sizes[1] > 60_000
