"""License scan: exact phrases, and short notices with a bounded number of edits.

A notice may differ by ``k`` characters, one in ``EDIT_EVERY``. It is cut into
k + 1 pieces, one of which must occur unchanged (pigeonhole); one Aho-Corasick
automaton finds the pieces of all notices. Around each hit the regex library
matches the notice with at most k errors, in its best-match mode, and reports
the edits. Each hit has a window of its own, so of occurrences that stand side by side all are found, in time
proportional to the hits; matches that overlap one with fewer edits go.

Text is searched as its words (A-Z lower-cased; letters, digits and bytes from 128)
with single blanks between them, and spans are mapped back to code points of the
original text. Null and empty texts have no words and no labels, an empty table has no rows, very long texts are
scanned whole. Every row is scanned on its own, so ties and repeated rows need no rule; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusmill.llm.common import WORDS, pieces, raw, texts

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
EDIT_EVERY = 12

#: (label, words of the notice)
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long, edits: int>>"
)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces that make up the notice."""
    n = len(notice)
    ends = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def nearest(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches (notice, start, end, edits) that overlap none with fewer edits that stays; in order of start."""
    out: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # of the union of what stays, with its ends
    ends: list[int] = []
    for _, level in groupby(sorted(matches, key=lambda m: m[3]), key=lambda m: m[3]):
        free = []
        for m in level:
            i = bisect_right(ends, m[1])
            if i == len(ends) or starts[i] >= m[2]:
                free.append(m)
        out += free
        merged: list[list[int]] = []
        for a, b in sorted([*zip(starts, ends, strict=True), *((m[1], m[2]) for m in free)]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        starts, ends = [a for a, _ in merged], [b for _, b in merged]
    return sorted(out, key=lambda m: m[1:])


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES) -> None:
        self.notices, self.patterns = notices, []
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice) in enumerate(notices):
            edits = len(notice) // EDIT_EVERY
            self.patterns.append((edits, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
            for offset, piece in seeds(notice, edits):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words; matches of a notice don't overlap."""
        places: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text) if len(self.automaton) else ():
            places.update((i, last + 1 - size - offset) for i, offset in uses)
        best: dict[tuple[int, int, int], int] = {}
        for i, start in places:
            edits, pattern = self.patterns[i]
            low, high = max(0, start - edits), min(len(text), start + len(self.notices[i][1]) + edits)
            if (m := pattern.search(text, low, high)) and m.end() > m.start():
                best[i, m.start(), m.end()] = sum(m.fuzzy_counts)
        out, ends = [], {}
        for (i, start, end), edits in sorted(best.items(), key=lambda x: (x[0][0], x[1], x[0])):
            own = ends.setdefault(i, ([], []))
            at = bisect_right(own[1], start)
            if at == len(own[0]) or own[0][at] >= end:  # matches of a notice don't overlap
                own[0].insert(at, start)
                own[1].insert(at, end)
                out.append((i, start, end, edits))
        return nearest(out)

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = text.translate(WORDS).split()
        joined = b" ".join(words)
        starts, base = [], set()
        padded = b" " + joined + b" "
        if b" license " in padded:
            for phrase, label in BASE:
                at = padded.find(needle := b" " + phrase.encode() + b" ")
                before, word = 0, 0
                while at >= 0:
                    base.add(label)
                    word += padded.count(b" ", before, at)
                    starts.append(word)
                    before, at = at, padded.find(needle, at + 1)
        lowered = joined.decode()
        found = self.fuzzy(lowered)
        labels = base | {self.notices[i][0] for i, *_ in found}
        score = 1.0 if base else max((1 - e / len(self.notices[i][1]) for i, _, _, e in found), default=0.0)
        spans = []
        if found:
            places = [m.span() for m in WORD.finditer(text.decode())]
            begins, at = [], 0
            for a, b in places:
                begins.append(at)
                at += b - a + 1
            for i, start, end, edits in found:
                first, last = bisect_right(begins, start) - 1, bisect_right(begins, end - 1) - 1
                spans.append({"label": self.notices[i][0], "start": places[first][0], "end": places[last][1], "edits": edits})
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
        )


@cache
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(notices)


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row for each row of docs."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(notices)
        for batch in pieces(batches):
            rows = [find.scan(x) for x in raw(batch.column(1))]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return texts(docs).mapInArrow(run, SCHEMA)
