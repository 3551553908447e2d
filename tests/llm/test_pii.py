import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    """The patterns as they are stated, with their checks."""
    out = []
    for kind, (name, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            even = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and even % 10 == 0):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()ab\n", max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111112", "192.168.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.co", "a@@b.co", "@x.y", "+1 (555) 010-9999", "+12", "a.b@c-d.e.f.", "é", ",", " "]), max_size=10))
def test_base_patterns_on_near_forms(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_gradients():
    rng = np.random.default_rng(1)
    net = pii.Network(hidden=3)
    x, y = rng.integers(0, pii.CLASSES, (6, 4)), rng.integers(0, pii.TAGS, (6, 4))
    _, grads = net.loss(x, y)
    for name, at in (("start", (1,)), ("move", (2, 1)), ("bias", (0,)), ("out", (4, 2)), ("in_f", (x[0, 0], 5)), ("in_b", (x[3, 1], 2)), ("rec_f", (1, 7)), ("rec_b", (2, 0))):
        kept, step = net.p[name][at], 1e-5
        net.p[name][at] = kept + step
        up = net.loss(x, y)[0]
        net.p[name][at] = kept - step
        down = net.loss(x, y)[0]
        net.p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_viterbi_equals_every_path():
    import itertools

    rng = np.random.default_rng(2)
    tagger = pii.Network(hidden=2).compiled()
    em = rng.normal(size=(4, pii.TAGS, 1)).astype(np.float32)
    value = lambda p: tagger.start[p[0]] + sum(em[t, p[t], 0] for t in range(4)) + sum(tagger.move[a, b] for a, b in itertools.pairwise(p))
    assert tuple(tagger.viterbi(em)[:, 0]) == max(itertools.product(range(pii.TAGS), repeat=4), key=value)


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def found(tagger, text):
    return pii.spans(text, tagger.decoded([text])[0], pii.base_spans(text))


def test_forms_beyond_the_patterns(tagger):
    words = "the quick brown fox jumps over a lazy dog while rivers run to the sea "
    forms = ["jane.doe [at] example [dot] org", "mark(at)server(dot)net", "4111.1111.1111.1111", "(212) 555-0198", "212-555-0198", "192[.]168[.]10[.]77", "10 dot 20 dot 30 dot 40"]
    hits = [any(words.__len__() - 3 <= s <= len(words) + 3 and e > s for s, _, e in found(tagger, f"{words}{x} {words}")) for x in forms]
    assert sum(hits) >= 5, hits
    assert found(tagger, words * 20) == []
    assert found(tagger, "on 2024-01-31 at 12:30:45 version 1.2.3 cost $12,345.67 " * 5) == []


def test_base_spans_stay(tagger):
    text = "write to a@b.co, 4111 1111 1111 1111 or +1 555 010 9999 from 10.0.0.1 " * 3
    assert set(pii.base_spans(text)) <= set(found(tagger, text))


def test_results_do_not_depend_on_the_batch_and_whole_texts_are_read(tagger):
    long = "plain words here " * 3000 + "mail bob [at] example [dot] com now"
    alone, (_, together, _) = tagger.decoded([long])[0], tagger.decoded(["x", long, ""])
    assert alone == together
    where = len("plain words here " * 3000)
    assert all(s >= where for s, _, _ in found(tagger, long))


def plain_emissions(net, x):
    """The two LSTMs by their formulas, a character at a time; less the outside tag's emission."""
    h, sigmoid = net.hidden, lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for d in "fb":
        state, cell, out = np.zeros(h), np.zeros(h), []
        for c in x if d == "f" else x[::-1]:
            z = net.p[f"in_{d}"][c] + state @ net.p[f"rec_{d}"]
            cell = sigmoid(z[:h]) * cell + (1 - sigmoid(z[:h])) * np.tanh(z[2 * h :])
            state = sigmoid(z[h : 2 * h]) * np.tanh(cell)
            out.append(state)
        sides.append(out if d == "f" else out[::-1])
    em = np.concatenate(sides, axis=1) @ net.p["out"] + net.p["bias"]
    return em[:, 1:] - em[:, :1]


def random_network(seed, move=1.0):
    rng = np.random.default_rng(seed)
    net = pii.Network(seed, hidden=4)
    net.p["out"], net.p["move"], net.p["start"] = rng.normal(0, 2, net.p["out"].shape), rng.normal(0, move, (pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    net.p["bias"] = np.r_[rng.uniform(0, 3), rng.normal(size=pii.TAGS - 1)]
    return net, rng


def test_emissions_are_the_networks():
    net, rng = random_network(3)
    data = rng.integers(0, pii.CLASSES, 60)
    starts, sizes = np.array([5, 0, 30, 59]), np.array([25, 17, 17, 1])
    em = net.compiled().emissions(data, starts, sizes)
    for i, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        assert np.allclose(em[:n, :, i], plain_emissions(net, data[a : a + n]), atol=1e-4)


@pytest.mark.parametrize("seed", range(12))
def test_decoding_of_open_places_is_the_best_path(seed):
    net, rng = random_network(seed, 0.3 + seed / 4)
    tagger = net.compiled()
    data = rng.integers(0, pii.CLASSES, 400)
    sizes = np.sort(rng.integers(1, 40, 30))[::-1]
    starts = rng.integers(0, 360, 30)
    for (a, n), runs in zip(zip(starts, sizes, strict=True), tagger.runs(data, starts, sizes), strict=True):
        em = np.zeros((n, pii.TAGS, 1), np.float32)
        em[:, 1:, 0] = plain_emissions(net, data[a : a + n])
        tags, told = tagger.viterbi(em)[:, 0], np.zeros(n, np.uint8)
        for kind, c, d, _, at_start, at_end in runs:
            told[c:d] = kind + 1
            assert at_start == (c == 0) and at_end == (d == n)
        value = lambda p: tagger.start[p[0]] + em[np.arange(n), p, 0].sum() + tagger.move[p[:-1], p[1:]].sum()  # noqa: B023, E731
        assert value(told) == pytest.approx(value(tags), abs=1e-3)


def test_windows_are_reconciled():
    whole = lambda kind, a, b, score=1.0: (kind, a, b, score, False, False)
    assert pii.reconciled([whole(0, 3, 9), whole(0, 3, 9)]) == [(3, 0, 9)]
    # Two halves of a span over a border, and half a span that the other window doesn't have.
    assert pii.reconciled([(2, 90, 100, 1.0, False, True), (2, 95, 110, 2.0, True, False)]) == [(90, 2, 110)]
    assert pii.reconciled([(2, 90, 100, 1.0, False, True)]) == []
    assert pii.reconciled([(1, 90, 100, 1.0, True, False), whole(1, 200, 210)]) == [(200, 1, 210)]
    # Over all spans at once: two small ones beat the one between them, a large one beats both.
    assert pii.reconciled([whole(0, 0, 10, 2.0), whole(1, 8, 22, 3.0), whole(3, 20, 30, 2.0)]) == [(0, 0, 10), (20, 3, 30)]
    assert pii.reconciled([whole(0, 0, 10, 2.0), whole(1, 8, 22, 5.0), whole(3, 20, 30, 2.0)]) == [(8, 1, 22)]


def test_windows_give_what_one_undivided_pass_gives(tagger):
    """Spans of every kind at every place of the borders of small windows."""
    forms = ["jane.doe [at] example [dot] org", "4111.1111.1111.1111", "212-555-0198", "a.person@some-host.example.org", "192[.]168[.]10[.]77"]
    words, same, total = "the river runs down to the old mill and on to the sea where ships come in ", 0, 0
    for form in forms:
        for lead in range(0, 75, 5):
            text = words[:lead].rsplit(" ", 1)[0] + " " + form + " " + words * 2
            some, undivided = (pii.spans(text, tagger.decoded([text], inner)[0], []) for inner in (64, 10**6))
            total += 1
            same += some == undivided
    assert same >= 0.9 * total, (same, total)


def test_a_very_long_span_stays(tagger):
    text = "mail " + "a" * 150 + " [at] example [dot] org now"
    assert pii.plausible(text, 0, 5, 5 + 150 + len(" [at] example [dot] org")) == (5, 5 + 150 + len(" [at] example [dot] org"))


def test_rows(spark, tagger):
    rows = [(1, None, "k"), (2, "", "k"), (3, "a@b.co", "k"), (3, "a@b.co", "k"), (None, "10.0.0.1 and 10.0.0.2", "k"), (4, "é a@b.co", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.find(df, tagger).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out))
    assert got == sorted(
        [(1, 0, 0, 0, 0, sha(""), ""), (2, 0, 0, 0, 0, sha(""), ""), *[(3, 1, 0, 0, 0, sha("email:0:6"), "email:0:6")] * 2, (-1, 0, 2, 0, 0, sha("ip:0:8,ip:13:21"), "ip:0:8,ip:13:21"), (4, 1, 0, 0, 0, sha("email:2:8"), "email:2:8")]
    )
    assert pii.find(df.where("false"), tagger).count() == 0


def test_masked():
    assert pii.masked("x a@b.co y", [(2, 0, 8)]) == "x [email] y"
    assert pii.masked("+1 555 010 9999", [(0, 3, 15), (1, 2, 15)]) == "[phone]"
