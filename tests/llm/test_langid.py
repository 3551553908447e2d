import zlib

import numpy as np
import pytest

from corpusmill.llm import langid

COLUMNS = "doc_id long, text string, lang string, score int, lang_pred string"


def brute(text):
    """Sum of the bound trigrams of a text, letter by letter."""
    letters = langid.letter_vectors().astype(np.int64)
    ids = []
    for c in text.lower() + "\n":
        letter = (ord(c) if ord(c) < langid.OWN else langid.OWN + ord(c) % 256) if c.isalpha() else 0
        if letter or (ids and ids[-1]):
            ids.append(letter)
    out = np.zeros(langid.DIMENSIONS, np.int64)
    for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


@pytest.mark.parametrize("text", ["the cat", "a", "Ünïcode ñ — 12 ça", "x1y2  z", "日本語 text", "  12 leading", "end!"])
def test_bundles_equal_brute_force_at_any_place(text):
    vectors, lettered = langid.bundles([text, "other words", "", text])
    assert lettered.tolist() == [True, True, False, True]
    assert np.array_equal(vectors[0], brute(text)) and np.array_equal(vectors[3], brute(text))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_columns_other_than_text_change_nothing(spark):
    """A held-out row's lang teaches nothing and is no input."""
    base = [(i, t, l, 0, "x") for i in range(40) for t, l in [(("the cat and the dog", "en"), ("le chat et le chien", "fr"))[i % 2]]]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    swapped = [(i, t, "xx" if i in held else l, s, p) for i, t, l, s, p in base]
    first, second = ([(r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, COLUMNS)).orderBy("doc_id").collect()] for x in (base, swapped))
    assert first == second and {p for _, p, _ in first} == {"en", "fr"}


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en", 0, "x") for i in range(12)] + [(20, None, "en", 0, "x"), (21, "", "fr", 0, "x"), (22, "12 34 !", None, 0, "x"), (None, "cat", None, 0, "x"), (23, "the dog", None, 0, "x"), (23, "the dog", None, 0, "x"), (24, "word " * 200_000, None, 0, "x")]
    df = spark.createDataFrame(rows, COLUMNS)
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [(by[i].lang_pred, by[i].score) for i in (20, 21, 22)] == [("und", 0.0)] * 3
    assert by[23].lang_pred == by[24].lang_pred == by[None].lang_pred == "en"
    assert not by[None].held_out
    assert langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
