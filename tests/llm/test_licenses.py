import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import licenses as li

SCANNER = li.Scanner()


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    starts = [i for phrase, _ in li.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = sorted({label for phrase, label in li.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "mit", "License", "license", "apache", "general", "public", "é", "x-y", "_", " ", "\n", "!", "\x7f", "0"]), max_size=30).map(" ".join))
def test_base_is_brute_force(text):
    assert SCANNER.scan(text.encode())[:5] == brute_base(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, len(li.NOTICES) - 1), st.data())
def test_seeds_find_every_notice_with_allowed_edits(i, data):
    label, notice = li.NOTICES[i]
    text, edits = notice, len(notice) // li.EDIT_EVERY
    for _ in range(edits):
        at = data.draw(st.integers(1, len(text) - 2))
        text = data.draw(st.sampled_from([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]]))
    assert regex.search(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}", text)
    found = SCANNER.fuzzy("words before " + text + " words after")
    assert any(li.NOTICES[j][0] == label for j, *_ in found) or min(e for *_, e in found) < edits


def test_spans_are_code_points_of_the_text():
    text = "É: Licensd under the\nApache Licence, Version 2.0! – end"
    *_, labels, score, spans = SCANNER.scan(text.encode())
    assert labels == "apache" and 0.9 < score < 1
    assert [text[s["start"] : s["end"]] for s in spans] == ["Licensd under the\nApache Licence, Version 2.0"]


A, B = "Licensd under the MIT license.", "Licensed under the MIT license."


@pytest.mark.parametrize("parts", [(A, B), (B, A), (A, A), (B, B), (A, B, A, B), ("released undr the mit license", "released under the mit license")])
def test_notices_side_by_side_are_all_found(parts):
    text, at, want = "", 0, []
    for part in parts:
        text += part + " "
        want.append((at, at + len(part.rstrip("."))))
        at = len(text)
    assert [(s["start"], s["end"]) for s in SCANNER.scan(text.encode())[7]] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 5, 7, 9, 12]), st.integers(0, 2), st.sampled_from(["", " and", " some other words here"])), min_size=1, max_size=6), st.randoms())
def test_every_span_against_brute_force(parts, rng):
    """Each planted notice is in a span that is no worse; each span is as far from its notice as it says."""
    text, planted = "start", []
    for i, edits, filler in parts:
        notice = li.NOTICES[i][1]
        edits = min(edits, len(notice) // li.EDIT_EVERY)
        for _ in range(edits):
            at = rng.randrange(1, len(notice) - 1)
            notice = rng.choice([notice[:at] + notice[at + 1 :], notice[:at] + "q" + notice[at:], notice[:at] + "q" + notice[at + 1 :]])
        text += filler + " "
        planted.append((i, len(text), len(text) + len(notice), edits))
        text += notice
    found = SCANNER.fuzzy(text)
    for i, start, end, edits in planted:
        assert any(s < end and e > start and n <= edits for _, s, e, n in found), (i, text[start:end])
    for i, start, end, edits in found:
        assert distance(text[start:end], li.NOTICES[i][1]) <= edits <= len(li.NOTICES[i][1]) // li.EDIT_EVERY


def test_many_copies_take_time_in_proportion():
    text = "released undr the mit license " * 5000
    assert len(SCANNER.fuzzy(text)) == 5000


def test_nearest_notice_wins():
    assert SCANNER.scan(b"Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc"


def test_clean_texts_have_no_labels():
    assert SCANNER.scan(b"The permit licence is under the general rule of public life.")[5] == ""


def test_operator_and_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "MIT License " * 20000, "x"), (3, "MIT license", "x"), (None, "Released under the MIT License.", "x")], "doc_id long, text string, labels string")
    rows = {(r.doc_id, r.n_words): r for r in li.scan(docs).collect()}
    assert rows[1, 0].labels == "" and rows[1, 0].spans == []
    assert rows[3, 40000].n_base == 20000 and rows[3, 40000].last_word == 39998
    assert rows[3, 2].base_labels == "mit" and rows[None, 5].score == 1.0
    assert li.scan(docs).count() == 5 and li.scan(docs.where("false")).count() == 0
    assert rows[2, 0].first_word is None and rows[2, 0].score == 0.0


def test_other_notices(spark):
    docs = spark.createDataFrame([(1, "Contact the moon office")], "doc_id long, text string")
    assert li.scan(docs, (("own", "contact the sun office"),)).first().labels == ""
    assert li.scan(docs, (("own", "contact the moon offices"),)).first().labels == "own"


@pytest.mark.parametrize("notice", [n for _, n in li.NOTICES])
def test_pieces_make_up_the_notice(notice):
    k = len(notice) // li.EDIT_EVERY
    parts = li.seeds(notice, k)
    assert "".join(p for _, p in parts) == notice and len(parts) == k + 1 and all(parts)
