"""Personal data: exact patterns, and a character BiLSTM with a CRF for other forms.

The base patterns give email, ip, card and phone spans. The method reads every
character of every text in overlapping windows with a bidirectional LSTM;
linear-chain CRF transitions decode each window, and ``reconciled`` makes one list of
spans for the whole text out of what the windows say: runs of one kind that
meet or overlap are one span, whichever windows they are from; a run that a
window's cut edge ends stays only if the neighbour, which sees beyond that edge, decodes some of
it too; of spans of different kinds that overlap, those of the largest sum of scores stay.

The bounds of an added span are the network's, moved to the edges of the words they cut. A span is kept if its characters can be
such data (four numbers up to 255 for an ip, Luhn for cards, digit counts for phones, a domain for
emails) and it overlaps no base span; it adds forms like ``name [at] host [dot] org``,
``10[.]0[.]0[.]1``, phones without a plus, or dotted card numbers.

The network is trained in numpy on the driver, from slices of ``SLICE`` characters of at most ``SAMPLE``
documents (taken by a hash of doc_id; both bounds keep the fit the same at any
corpus size) with the base patterns' spans and with made-up data written into them
in many forms, beside numbers that aren't personal data. Inference has no such bound.

Viterbi runs over the places that a bound doesn't prove to be outside (see ``Tagger.runs``), and a
window that a task has read before isn't read again; the results are the same.

Null and empty texts have no spans, an empty table has no rows. A very long text is read whole, window by window.
Offsets are code points, ends exclusive. Every row is read on its own, so ties and repeated rows need
no rule, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces, strings, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1
HIDDEN = 10
INNER, MARGIN = 1000, 24
BATCH = 1024
#: Windows whose result a task remembers.
REMEMBERED = 1 << 16
SAMPLE = 2000
SLICE = 1000

# -- base patterns ----------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins at the first digit of its run: a start within a run fails if that one does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(x := digits_of(m[0])) <= 19 and luhn(x)]
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# -- what a decoded span must look like -------------------------------------

AT = r"\s{0,2}(?:@|\(at\)|\[at\]|\bat\b)\s{0,2}"
DOT = r"\s{0,2}(?:\.|\(\.\)|\[\.\]|\(dot\)|\[dot\]|\bdot\b)\s{0,2}"
WRITTEN_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
WRITTEN_IP = re.compile(rf"[0-9]+(?:{DOT}[0-9]+){{3}}", re.IGNORECASE)
WRITTEN_CARD = re.compile(r"[0-9](?:[ ./-]?[0-9])+")
WRITTEN_PHONE = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])+")
WRITTEN = (WRITTEN_EMAIL, WRITTEN_IP, WRITTEN_CARD, WRITTEN_PHONE)


def plausible(text: str, kind: int, start: int, end: int) -> tuple[int, int] | None:
    """A decoded span at the edges of its words, if its characters can be such data."""
    while start > 0 and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    first = "([+" if kind == 3 else ""
    while start < end and not text[start].isalnum() and text[start] not in first:
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    part = text[start:end]
    if not WRITTEN[kind].fullmatch(part):
        return None
    digits = digits_of(part)
    if kind == 1 and any(int(x) > 255 for x in re.findall("[0-9]+", part)):
        return None
    if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
        return None
    if kind == 3 and not (10 <= len(digits) <= 15 and re.search("[ ().-]", part)):
        return None
    # A part of a longer number or name is none of these.
    if kind and (re.search(r"[0-9][.,:/]$|\w-$|_$", text[max(0, start - 2) : start]) or re.match(r"[.,:/][0-9]|-\w|_", text[end : end + 2])):
        return None
    return start, end


# -- the network ------------------------------------------------------------

PAD, DIGIT_CLASS, LETTER, OTHER = 0, 1, 2, 3
CLASSES = 4 + 26 + 33


def _class_table() -> np.ndarray:
    table = np.full(128, OTHER, np.uint8)
    marks = [c for c in range(128) if not chr(c).isalnum() and (c >= 32 or c in (9, 10)) and c != 127]
    for i, c in enumerate(marks[:33]):
        table[c] = 30 + i
    for c in range(26):
        table[65 + c] = table[97 + c] = 4 + c
    table[48:58] = DIGIT_CLASS
    return table


CLASS_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, CLASS_TABLE[np.minimum(points, 127)], LETTER).astype(np.uint8)


class Network:
    """Two LSTMs over embedded characters, linear emissions, CRF transitions.

    Input and forget gates are coupled (input = 1 - forget; Greff et al. 2017), which is as accurate with a quarter less work.
    """

    def __init__(self, seed: int = 11, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"start": np.zeros(TAGS), "move": np.eye(TAGS) - 0.5, "bias": np.array([1.0] + [0.0] * (TAGS - 1)), "out": rng.normal(0, 0.3, (2 * hidden, TAGS))}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.3, (CLASSES, 3 * hidden))
            self.p[f"in_{d}"][:, :hidden] += 0.5  # forget gates begin open
            self.p[f"rec_{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden))

    # training: arrays are (time, batch, features); gates in order forget, output, candidate

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h = self.hidden
        rows, rec = self.p[f"in_{d}"][x], self.p[f"rec_{d}"]
        state = cell = np.zeros((x.shape[1], h))
        out, kept = np.empty((*x.shape, h)), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = rows[t] + state @ rec
            gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 2 * h])
            cand = np.tanh(z[:, 2 * h :])
            before, prior = cell, state
            cell = cand + gates[:, :h] * (cell - cand)
            th = np.tanh(cell)
            state = gates[:, h:] * th
            out[t] = state
            kept.append((t, gates, cand, before, th, prior))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, grads: dict) -> None:
        h, rec = self.hidden, self.p[f"rec_{d}"]
        g_rows, g_rec = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(rec)
        dh = dc = np.zeros((x.shape[1], h))
        for t, gates, cand, before, th, prior in reversed(kept):
            dh = dh + grad[t]
            f, o = gates[:, :h], gates[:, h:]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * (before - cand) * f * (1 - f), dh * th * o * (1 - o), dc * (1 - f) * (1 - cand * cand)], axis=1)
            g_rec += prior.T @ dz
            np.add.at(g_rows, x[t], dz)
            dh, dc = dz @ rec.T, dc * f
        grads[f"in_{d}"], grads[f"rec_{d}"] = g_rows, g_rec

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tag sequences, and gradients. x, y: (time, batch)."""
        steps, n = x.shape
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        em = both @ self.p["out"] + self.p["bias"]
        move = self.p["move"]
        alpha = np.empty_like(em)
        alpha[0] = self.p["start"] + em[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + move, 1) + em[t]
        total = _lse(alpha[-1], 1)
        beta = np.zeros_like(em)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(move + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        g_em = np.exp(alpha + beta - total[None, :, None])
        g_start, g_move = g_em[0].sum(axis=0), np.zeros_like(move)
        for t in range(1, steps):
            g_move += np.exp(alpha[t - 1][:, :, None] + move + (em[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        at, col = np.arange(steps)[:, None], np.arange(n)[None, :]
        gold = self.p["start"][y[0]] + em[at, col, y].sum(axis=0) + move[y[:-1], y[1:]].sum(axis=0)
        g_em[at, col, y] -= 1
        np.add.at(g_start, y[0], -1)
        np.add.at(g_move, (y[:-1], y[1:]), -1)
        grads = {"start": g_start / n, "move": g_move / n, "bias": g_em.sum(axis=(0, 1)) / n, "out": np.tensordot(both, g_em, ((0, 1), (0, 1))) / n}
        g_both = g_em @ self.p["out"].T / n
        h = self.hidden
        self._back(x, "f", kf, g_both[:, :, :h], grads)
        self._back(x, "b", kb, g_both[:, :, h:], grads)
        return float((total - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 5) -> Network:
        """Adam over windows x, y: (windows, time)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            use = rng.integers(0, len(x), batch)
            _, grads = self.loss(x[use].T, y[use].T)
            size = np.sqrt(sum((g * g).sum() for g in grads.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / size)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def compiled(self) -> Tagger:
        return Tagger(self)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: A run of one tag in a window: kind, start, end, score, and whether the window's first or last character is in it.
Run = tuple[int, int, int, float, bool, bool]


class Tagger:
    """float32 inference; arrays are (features, directions, windows), so that each step is a few wide operations.

    Windows are sorted by length and both directions begin at a window's own end, so each step works
    on the windows that still have characters, and no window is padded.
    """

    def __init__(self, net: Network) -> None:
        h = self.hidden = net.hidden
        # Negated, as a sigmoid is 1 / (1 + exp(-x)); a tanh is 2 * sigmoid(2 x) - 1. States are kept halved, so what reads them is doubled.
        scale = np.r_[np.full(2 * h, -1.0), np.full(h, -2.0)]
        self.rows = np.ascontiguousarray(np.concatenate([net.p[f"in_{d}"] * scale for d in "fb"]).T.astype(np.float32))
        self.rec = [np.ascontiguousarray((2 * net.p[f"rec_{d}"] * scale).T.astype(np.float32)) for d in "fb"]
        over = 2 * (net.p["out"][:, 1:] - net.p["out"][:, :1])  # only differences from the outside tag matter
        self.out = [np.ascontiguousarray(part.T.astype(np.float32)) for part in (over[:h], over[h:])]
        self.bias = (net.p["bias"][1:] - net.p["bias"][0]).astype(np.float32)
        self.start, self.move = net.p["start"].astype(np.float32), net.p["move"].astype(np.float32)
        self.seen: dict[bytes, tuple[Run, ...]] = {}

    def emissions(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(time, tags but the outside one, windows): emissions less the outside tag's.

        data: classes as indexes. sizes fall; beyond a window's end the numbers mean nothing.
        """
        h, n, steps = self.hidden, len(starts), int(sizes[0])
        ends = starts + sizes - 1
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # windows longer than t
        em = (np.empty if sizes[-1] == steps else np.zeros)((2, steps, TAGS - 1, n), np.float32)
        x = np.empty((2, n), np.intp)
        state, cell = np.zeros((h, 2, n), np.float32), np.zeros((h, 2, n), np.float32)
        whole, prod, temp = np.empty((3 * h, 2, n), np.float32), np.empty((3 * h, 2, n), np.float32), np.empty((h, 2, n), np.float32)
        with np.errstate(over="ignore"):
            for t in range(steps):
                m = int(active[t])
                np.take(data, starts[:m] + t, out=x[0, :m], mode="clip")
                np.take(data, ends[:m] - t, out=x[1, :m], mode="clip")
                x[1, :m] += CLASSES
                if m == n:
                    s, c, z, e, p = state, cell, whole, temp, prod
                    np.take(self.rows, x, axis=1, out=z, mode="clip")
                else:
                    s, c, e, p = state[:, :, :m], cell[:, :, :m], temp[:, :, :m], prod[:, :, :m]
                    z = np.take(self.rows, x[:, :m], axis=1, mode="clip")
                for d in (0, 1):
                    np.matmul(self.rec[d], s[:, d], out=p[:, d])
                z += p
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                forget, out, cand = z[:h], z[h : 2 * h], z[2 * h :]
                cand -= 0.5
                c -= cand
                c *= forget
                c += cand  # half the cell
                np.multiply(c, -4, out=e)
                np.exp(e, out=e)
                e += 1
                np.reciprocal(e, out=e)
                e -= 0.5
                np.multiply(e, out, out=s)
                for d in (0, 1):
                    np.matmul(self.out[d], s[:, d], out=em[d, t, :, :m])
        forth, back = em
        if sizes[-1] == steps:
            forth += back[::-1]
        else:
            forth += np.take_along_axis(back, np.maximum(sizes - 1 - np.arange(steps)[:, None], 0)[:, None, :], axis=0)
        forth += self.bias[:, None]
        return forth

    def viterbi(self, em: np.ndarray, sizes: np.ndarray | None = None, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Tags (time, sequences) of the best paths of emissions (time, tags, sequences).

        sizes fall, and beyond a sequence's end the tag is 0. first and last: whether a sequence begins and ends where its
        window does; else the outside tag is before and after it.
        """
        steps, _, n = em.shape
        sizes = np.full(n, steps) if sizes is None else sizes
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        back = np.empty((steps, TAGS, n), np.uint8)
        score = em[0] + (self.start[:, None] if first is None else np.where(first, self.start[:, None], self.move[0][:, None]))
        for t in range(1, steps):
            m = int(active[t])
            ways = score[:, None, :m] + self.move[:, :, None]
            back[t, :, :m] = ways.argmax(axis=0)
            score[:, :m] = ways.max(axis=0) + em[t, :, :m]
        out = np.zeros((steps, n), np.uint8)
        tag = (score if last is None else score + np.where(last, 0, self.move[:, 0][:, None])).argmax(axis=0)
        for t in range(steps - 1, -1, -1):
            m = int(active[t])
            out[t, :m] = tag[:m]
            if t:
                tag[:m] = back[t, tag[:m], np.arange(m)]
        return out

    def open_places(self, em: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(time, windows): places that the best path may tag; at all others it is proved to be outside.

        A path's score over the all-outside path is the sum over its runs. With the cost of leaving a tag
        charged in advance, a place adds at most ``r``, whatever its tag and the one before. A place
        is in no run if every interval around it has a negative sum of r.
        """
        steps = len(em)
        w = self.move - self.move[0, 0]
        leave = w[1:, 0]
        most = np.maximum(w[0, 1:] + leave, (w[1:, 1:] - leave[:, None] + leave).max(axis=0))
        r = (em[:, 0] + most[0]).copy()
        for k in range(1, TAGS - 1):
            np.maximum(r, em[:, k] + most[k], out=r)
        at, column = np.arange(len(sizes)), sizes - 1
        begin = np.maximum(most, self.start[1:] - self.start[0] + leave)
        r[0] = (em[0] + begin[:, None]).max(axis=0)
        # At a window's end a run needn't leave its tag.
        r[column, at] = np.maximum(r[column, at], (em[column, :, at] + np.maximum(most, begin) - leave).max(axis=1))
        if sizes[-1] < steps:
            r[np.arange(steps)[:, None] >= sizes] = -np.inf
        left, right = r.copy(), r.copy()  # the best sum of an interval that ends, begins here
        for t in range(1, steps):
            left[t] += np.maximum(left[t - 1], 0)
            right[steps - 1 - t] += np.maximum(right[steps - t], 0)
        left += right
        left -= np.where(np.isinf(r), 0, r)
        return left >= -1e-4

    def runs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[Run, ...]]:
        """The decoded runs of each window; sizes fall."""
        em = self.emissions(data, starts, sizes)
        out: list[list[Run]] = [[] for _ in starts]
        places = self.open_places(em, sizes).T
        edges = np.diff(np.pad(places, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        window, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        order = np.argsort(begin - end, kind="stable")
        for at in range(0, len(order), 4 * BATCH):
            some = order[at : at + 4 * BATCH]
            w, a, b = window[some], begin[some], end[some]
            steps = np.minimum(a + np.arange((b - a)[0])[:, None], len(em) - 1)
            part = np.zeros((len(steps), TAGS, len(some)), np.float32)
            part[:, 1:] = em[steps, :, w].transpose(0, 2, 1)
            tags = self.viterbi(part, b - a, a == 0, b == sizes[w])
            for column in np.flatnonzero(tags.any(axis=0)).tolist():
                row = tags[: b[column] - a[column], column].astype(np.int64)
                bounds = np.flatnonzero(np.diff(np.r_[0, row, 0])).tolist()
                shift, size = int(a[column]), int(sizes[w[column]])
                for c, d in zip(bounds[:-1], bounds[1:], strict=True):
                    if tag := int(row[c]):
                        score = float(part[c:d, tag, column].sum())
                        out[w[column]].append((tag - 1, c + shift, d + shift, score, c + shift == 0, d + shift == size))
        return [tuple(x) for x in out]

    def decoded(self, bodies: list[str], inner: int = INNER) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of each text's spans, reconciled over its windows."""
        data = np.concatenate([np.zeros(0, np.uint8), *(classes(x) for x in bodies)])
        flat = data.tobytes()
        data = data.astype(np.intp)
        ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
        rows, starts, stops = [], [], []
        for i, (end, body) in enumerate(zip(ends.tolist(), bodies, strict=True)):
            first = end - len(body)
            for at in range(first, end, inner):
                rows.append(i)
                starts.append(max(first, at - MARGIN))
                stops.append(min(end, at + inner + MARGIN))
        keys = [flat[a:b] for a, b in zip(starts, stops, strict=True)]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen = self.seen
        new = sorted({key: a for key, a in zip(keys, starts, strict=True) if key not in seen}.items(), key=lambda x: -len(x[0]))
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            found = self.runs(data, np.array([a for _, a in part]), np.array([len(key) for key, _ in part]))
            seen.update(zip((key for key, _ in part), found, strict=True))
        own: list[list[tuple[int, Run, bool, bool]]] = [[] for _ in bodies]
        bounds = np.r_[0, ends].tolist()
        for w, key in enumerate(keys):
            for kind, a, b, score, at_start, at_end in seen[key]:
                i = rows[w]
                shift = starts[w] - bounds[i]
                own[i].append((kind, a + shift, b + shift, score, at_start and shift > 0, at_end and stops[w] < bounds[i + 1]))
        return [reconciled(x) if x else [] for x in own]


def reconciled(runs: list[Run]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a whole text, in order, from the runs of all its windows (places in the text; cut: by an edge within the text).

    Runs of a kind that meet or overlap are united; their score is the largest of them. A run with a cut edge that no
    other run supports goes: the neighbouring window has read beyond the edge and found nothing. Of
    overlapping spans of different kinds the set of the largest total score stays, found over all spans at once.
    """
    united: list[list] = []  # start, end, kind, score, complete
    for kind in range(len(KINDS)):
        last = None
        for _, a, b, score, cut_start, cut_end in sorted((r for r in runs if r[0] == kind), key=lambda r: (r[1], r[2])):
            if last is not None and a <= last[1]:
                last[1], last[3], last[4] = max(last[1], b), max(last[3], score), True
            else:
                last = [a, b, kind, score, not (cut_start or cut_end)]
                united.append(last)
    spans_ = sorted(((a, b, kind, score) for a, b, kind, score, complete in united if complete), key=lambda x: (x[1], x[0], x[2]))
    stops = [b for _, b, *_ in spans_]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (a, _, _, score) in enumerate(spans_):
        before = bisect_right(stops, a, 0, i)
        taken = best[before][0] + max(score, 1e-9)
        best.append((taken, before, True) if taken > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans_)
    while i:
        _, before, taken = best[i]
        if taken:
            a, b, kind, _ = spans_[i - 1]
            out.append((a, kind, b))
        i = before
    return out[::-1]


# -- training data ----------------------------------------------------------


class Maker:
    """Made-up personal data, and numbers that aren't."""

    def __init__(self, rng: np.random.Generator, words: list[str]) -> None:
        self.rng, self.words = rng, [w for w in words if w.isascii() and w.isalpha()] or ["alpha", "beta", "gamma"]

    def number(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def pick(self, *x):
        return x[self.rng.integers(len(x))]

    def word(self) -> str:
        return self.words[self.rng.integers(len(self.words))].lower()

    def email(self) -> str:
        local = self.pick(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.number(2)}", f"{self.word()}.{self.number(2)}", f"{self.word()}_{self.word()}")
        host = [self.pick(self.word(), f"mail{self.number(1)}", "example"), *self.pick([], ["example"], [self.word()]), self.pick("com", "org", "net", "de", "fr", "es", "edu", "io")]
        at, dot = self.pick(("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" (at) ", "."), (" @ ", "."), ("[at]", "."))
        return local + at + dot.join(host)

    def ip(self) -> str:
        dot = self.pick(".", ".", ".", "[.]", "(.)", "[dot]", " dot ", " . ", "(dot)")
        return dot.join(str(x) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        digits = self.pick("4", "51", "37", "6011") + self.number(14)
        digits = digits[: self.pick(15, 15, 15, 14, 12)]
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        sep = self.pick("", "", " ", "-", ".", "/")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.pick(f"+1 ({a}) {b}-{c}", f"+{self.number(2)} {self.number(2)} {b} {c}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {self.pick('1', '44', '49')} {a} {b} {c}")

    def other(self) -> str:
        n = self.number
        return self.pick(
            n(4), n(2), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{n(3)}.{n(2)}", f"${n(2)},{n(3)}.{n(2)}",
            f'token = "{self.rng.bytes(20).hex()}"', n(8), f"#{n(5)}", f"{n(2)}%", f"v{n(1)}.{n(2)}", f"{n(2)}/{n(2)}/{n(4)}", f"@{self.word()}", f"{self.word()} at {self.word()}",
            f"({n(1)})", f"{n(3)}-{n(3)}", f"{self.word()} dot {self.word()}", f"1.{n(1)} {self.word()}", f"{n(1)},{n(1)},{n(1)},{n(1)},{n(1)},{n(1)}", f"{n(3)} {n(3)} {n(3)} {n(3)} {n(3)} {n(3)} {n(3)}", f"+ {n(2)}", f"Version {n(1)}.{n(1)}",
        )


def training_windows(slices: list[str], n: int = 4000, length: int = 96, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of windows: slices of documents, with made-up data written in."""
    rng = np.random.default_rng(seed)
    slices = [x for x in slices if x.strip()] or ["alpha beta gamma delta. "]
    maker = Maker(rng, " ".join(slices[:200]).split())
    xs, ys = np.zeros((n, length), np.uint8), np.zeros((n, length), np.uint8)
    for row in range(n):
        body = slices[rng.integers(len(slices))]
        at = int(rng.integers(0, max(1, len(body) - length)))
        body = body[at : at + length + 40]
        made = []
        for _ in range(int(rng.choice(4, p=(0.25, 0.45, 0.2, 0.1)))):
            kind = int(rng.integers(0, 7))
            new = (maker.email, maker.ip, maker.card, maker.phone)[kind]() if kind < 4 else maker.other()
            gaps = [i for i, c in enumerate(body) if c in " \n" and not any(a <= i < b for a, b, _ in made)]
            place = gaps[rng.integers(len(gaps))] if gaps else 0
            lead, tail = maker.pick(" ", " ", "\n", ": ", " ("), maker.pick(" ", " ", ", ", ". ", "\n", ") ")
            size = len(lead) + len(new) + len(tail)
            made = [(a + size, b + size, k) if a >= place else (a, b, k) for a, b, k in made]
            if kind < 4:
                made.append((place + len(lead), place + len(lead) + len(new), kind))
            body = body[:place] + lead + new + tail + body[place:]
        tags = np.zeros(max(length, len(body)), np.uint8)
        for start, kind, end in base_spans(body):
            tags[start:end] = kind + 1
        for start, end, kind in made:
            tags[start:end] = kind + 1
        cut = int(rng.integers(0, max(1, len(body) - length + 1)))
        x = classes(body)[cut : cut + length]
        xs[row, : len(x)], ys[row, : len(x)] = x, tags[cut : cut + len(x)]
    return xs, ys


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Train on slices of at most about ``sample`` documents."""
    whole = texts(docs).where("text is not null and length(text) > 0")
    share = min(1.0, sample / max(1, whole.count()))
    part = whole.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    offset = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SLICE)) + 1
    rows = part.select("doc_id", F.substring("text", offset.cast("int"), F.lit(SLICE)).alias("slice")).orderBy("doc_id", "slice").limit(2 * sample).collect()
    return Network().fit(*training_windows([r.slice for r in rows])).compiled()


# -- the operator -----------------------------------------------------------


def spans(text: str, decoded: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and decoded spans that overlap none of them."""
    out = list(base)
    for start, kind, end in decoded:
        if found := plausible(text, kind, start, end):
            start, end = found
            if all(end <= s or start >= e for s, _, e in out):
                out.append((start, kind, end))
    return sorted(out) if len(out) > len(base) else base


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and found (array of kind, start, end): a row for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs))
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in pieces(batches, BATCH):
            bodies = strings(batch.column(1))
            base = [base_spans(x) for x in bodies]
            every = [spans(*x) for x in zip(bodies, tagger.decoded(bodies), base, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(len(KINDS))),
                    pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]),
                    pa.array([written(x) for x in every]),
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in every], found_type),
                ],
                names,
            )

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long>>"
    return texts(docs).mapInArrow(run, schema)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
