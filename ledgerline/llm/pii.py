"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds what they miss.

The tagger is trained here, in numpy, from labelled spans: those of the patterns in a bounded sample of documents
(``DOCS`` of those with a digit, an at sign or ``(at)``, chosen by a hash), and variants of them that the patterns
do not read: cards grouped by full stops, phone numbers without a plus, spelled-out at signs. Numbers in the sample that are
not personal data are its counter-examples.

A document is read in overlapping windows. Any span of these kinds holds a digit, an at sign or a spelled-out ``(at)``,
so only windows with one are decoded. A window's Viterbi spans that end at its edge are left to its
neighbour; those that no window has whole are read again as one sequence, in wide windows whose overlap holds the longest address
there can be (64 characters, an at sign, 255 characters). Spans of all windows of a document are then reconciled at once: the set without overlaps that has the
largest total confidence (weighted interval scheduling). Spans of the patterns always stay; the model adds a
span only where it is sure, and not where the check of its own kind has refused the same characters: a number that fails
Luhn is no card, however it is grouped, but may be a phone number.

A null text is empty and has no spans. Rows come back one for one, repeated or not; null ids are kept.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
WIDE = 768
HIDDEN = 16
DOCS = 600
MOST_CHARS = 20_000
#: Bound of the fit: windows that the tagger learns from, chosen at random from the sampled texts.
WINDOWS = 1600
STEPS = 240
SURE = 0.5
#: Spans of the model shorter than the shortest IP are no personal data; shorter addresses, as a@b.c, the pattern reads.
LEAST_CHARS = 7
#: What every span holds, and what a text or window is read for.
MARK = re.compile(r"[0-9@]|\(at\)", re.I)

# ---- fixed patterns ---------------------------------------------------------------------------

_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


_LOCAL = string.ascii_letters + string.digits + "._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the address pattern, found from each at sign outwards: a run of letters without one costs nothing."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at) if start < at else None
        at += 1
        if host:
            yield start, host.end()
            done = at = host.end()
        else:
            done = at


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    return (sum(values[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in values[-2::-2])) % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def checked_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of each kind in the order of ``KINDS``, and those of long enough matches that the check of their kind refused."""
    found, refused = [], []
    for kind, needs in zip(KINDS, ("@", ".", "", "+")):
        if needs in text:
            for start, end in email_spans(text) if kind == "email" else (m.span() for m in _PATTERNS[kind].finditer(text)):
                if _valid(kind, text[start:end]):
                    found.append((kind, start, end))
                elif end - start >= LEAST_CHARS:
                    refused.append((kind, start, end))
    return found, refused


def pattern_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """As ``checked_spans``, the refused ones without their kinds."""
    found, refused = checked_spans(text)
    return found, [s[1:] for s in refused]


# ---- the tagger -------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SYMBOLS = 100


def symbols(text: str) -> np.ndarray:
    """The symbol of every character: white space 0, printable ASCII by character but all digits alike, 95 for all else."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where((code > 32) & (code < 127), code - 32, np.where((code == 32) | (code >= 9) & (code <= 13), 0, 95)).astype(np.int64)
    out[(code >= 48) & (code <= 57)] = 16
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters: for each direction symbol table, recurrent matrix and bias of the four gates; output matrix; transitions."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = draw.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            self.p["h" + d] = draw.normal(0, 0.5 / hidden**0.5, (hidden, 4 * hidden))
            self.p["c" + d] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        self.p["out"] = draw.normal(0, 0.3, (2 * hidden, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["step"] = np.zeros((TAGS, TAGS))

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, t = x.shape
        h, c, k = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        out, kept = np.zeros((n, t, k)), []
        for at in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p["x" + d][x[:, at]] + h @ self.p["h" + d] + self.p["c" + d]
            i, f, o = (_sigmoid(z[:, j * k : (j + 1) * k]) for j in range(3))
            g = np.tanh(z[:, 3 * k :])
            old_h, old_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, at] = h
            kept.append((at, i, f, o, g, tc, old_h, old_c))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, slope: np.ndarray, grads: dict) -> None:
        dh, dc = np.zeros((len(x), self.hidden)), np.zeros((len(x), self.hidden))
        table, matrix, bias = (np.zeros_like(self.p[n + d]) for n in "xhc")
        every = np.arange(SYMBOLS)
        for at, i, f, o, g, tc, old_h, old_c in reversed(kept):
            dh = dh + slope[:, at]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            table += (x[:, at] == every[:, None]) @ dz
            matrix += old_h.T @ dz
            bias += dz.sum(axis=0)
            dh, dc = dz @ self.p["h" + d].T, dc * f
        grads["x" + d], grads["h" + d], grads["c" + d] = table, matrix, bias

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        (a, ka), (b, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        hidden = np.concatenate((a, b), axis=2)
        return hidden @ self.p["out"] + self.p["bias"], hidden, ka, kb

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores, log of the sum over paths, and the probability of each tag at each place."""
        n, t, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for at in range(1, t):
            a[:, at] = e[:, at] + _lse(a[:, at - 1][:, :, None] + self.p["step"][None], 1)
        for at in range(t - 2, -1, -1):
            b[:, at] = _lse(self.p["step"][None] + (e[:, at + 1] + b[:, at + 1])[:, None, :], 2)
        total = _lse(a[:, -1], 1)
        return a, b, total, np.exp(a + b - total[:, None, None])

    def learn(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of the tags."""
        e, hidden, ka, kb = self.emissions(x)
        a, b, total, p = self.marginals(e)
        n, t = x.shape
        slope = p.copy()
        np.add.at(slope, (np.arange(n)[:, None], np.arange(t)[None, :], y), -1)
        slope /= n
        step = np.zeros((TAGS, TAGS))
        for at in range(1, t):
            joint = a[:, at - 1][:, :, None] + self.p["step"][None] + (e[:, at] + b[:, at])[:, None, :] - total[:, None, None]
            step += np.exp(joint).sum(axis=0) / n
            np.add.at(step, (y[:, at - 1], y[:, at]), -1 / n)
        grads = {"step": step, "bias": slope.sum(axis=(0, 1)), "out": np.einsum("ntk,ntl->kl", hidden, slope)}
        back = slope @ self.p["out"].T
        self._back(x, "f", ka, back[:, :, : self.hidden], grads)
        self._back(x, "b", kb, back[:, :, self.hidden :], grads)
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Tagger:
        """Adam over about ``steps`` batches, however few windows there are."""
        epochs = -(-steps * batch // max(1, len(x)))
        draw, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                for k, g in self.learn(x[order[at : at + batch]], y[order[at : at + batch]]).items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def tags(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path (Viterbi) through each window, and the probability of each of its tags."""
        e = self.emissions(x)[0]
        n, t, _ = e.shape
        score, link = e[:, 0], np.zeros((n, t, TAGS), np.int64)
        for at in range(1, t):
            ways = score[:, :, None] + self.p["step"][None]
            link[:, at] = ways.argmax(axis=1)
            score = ways.max(axis=1) + e[:, at]
        path = np.zeros((n, t), np.int64)
        path[:, -1] = score.argmax(axis=1)
        for at in range(t - 1, 0, -1):
            path[:, at - 1] = link[np.arange(n), at, path[:, at]]
        return path, np.take_along_axis(self.marginals(e)[3], path[:, :, None], axis=2)[:, :, 0]


# ---- windows ----------------------------------------------------------------------------------


def window_starts(x: np.ndarray) -> np.ndarray:
    """Starts of the windows, a stride apart, that hold a digit, an at sign or any part of a spelled-out one."""
    starts = np.arange(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)
    marked = (x == 16) | (x == 32)
    spelled = np.flatnonzero((x[:-3] == 8) & np.isin(x[1:-2], (33, 65)) & np.isin(x[2:-1], (52, 84)) & (x[3:] == 9))
    marked[spelled[:, None] + np.arange(4)[None, :]] = True
    marks = np.concatenate(([0], np.cumsum(marked)))
    return starts[marks[np.minimum(starts + WINDOW, len(x))] > marks[np.minimum(starts, len(x))]]


def _windows(x: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    return np.concatenate((x, np.zeros(width, np.int64)))[starts[:, None] + np.arange(width)[None, :]]


def window_parts(path: np.ndarray, sure: np.ndarray, start: int, length: int) -> Iterator[tuple[str, int, int, float, bool]]:
    """Spans of one window with their least probability of a tag, and whether they are whole: not cut by an edge inside the text."""
    at, width = 0, len(path)
    while at < width:
        tag = path[at]
        if tag == 0 or tag % 2 == 0 and (at or start == 0):
            at += 1
            continue
        kind, inside = (tag - 1) // 2, 2 * ((tag - 1) // 2) + 2
        end = at + 1
        while end < width and path[end] == inside:
            end += 1
        stop = min(start + end, length)
        if stop > start + at:
            yield KINDS[kind], start + at, stop, float(sure[at:end].min()), (at > 0 or start == 0) and (end < width or stop == length)
        at = end


def wide_starts(cut: list[tuple[int, int]], length: int) -> list[int]:
    """Starts of the wide windows, half their width apart, that hold a part of any of the cut spans."""
    step, last = WIDE // 2, max(0, -(-(length - WIDE) // (WIDE // 2)))
    return sorted({step * k for start, end in cut for k in range(max(0, -(-(start + 1 - WIDE) // step)), min(last, (end - 1) // step) + 1)})


def reconciled(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of spans from all windows the set without overlaps whose confidences, by characters, add up to most."""
    best: dict[tuple[int, int], tuple[str, int, int, float]] = {}
    for s in sorted(spans, key=lambda s: (s[3], s[0])):
        best[s[1], s[2]] = s
    line = sorted(best.values(), key=lambda s: (s[2], s[1]))
    ends = [s[2] for s in line]
    total, choice = [0.0], []
    for k, s in enumerate(line):
        before = bisect_right(ends, s[1], 0, k)
        take = total[before] + s[3] * (s[2] - s[1])
        choice.append((take > total[k], before))
        total.append(max(total[k], take))
    out, k = [], len(line)
    while k:
        taken, before = choice[k - 1]
        if taken:
            out.append(line[k - 1][:3])
        k = before if taken else k - 1
    return out[::-1]


def _vetoed(text: str, span: tuple[str, int, int], refused: list[tuple[str, int, int]]) -> bool:
    """Whether the check of the span's own kind refused it: as a match of the same digits there, or as a card that fails Luhn."""
    kind, start, end = span
    digits = re.sub(r"[^0-9]", "", text[start:end])
    if kind == "card" and 16 <= len(digits) <= 19:
        return not luhn(digits)
    return any(k == kind and s < end and e > start and re.sub(r"[^0-9]", "", text[s:e]) == digits for k, s, e in refused)


def added_spans(tagger: Tagger, texts: list[str], known: list[list[tuple[str, int, int]]], refused: list[list[tuple[str, int, int]]], sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds to the ``known`` spans of each text."""
    own = [symbols(t) for t in texts]
    starts = [window_starts(x) for x in own]
    x = np.concatenate([_windows(a, s) for a, s in zip(own, starts)]) if texts else np.zeros((0, WINDOW), np.int64)
    which = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(x), 1024):
        path, p = tagger.tags(x[at : at + 1024])
        for k in np.flatnonzero(path.any(axis=1)):
            i = which[at + k]
            found[i] += window_parts(path[k], p[k], int(start[at + k]), len(texts[i]))
    again = []
    for i, (parts, base) in enumerate(zip(found, known)):
        whole = sorted(s[1:3] for s in [*(s for s in parts if s[4]), *base])
        reach = [0, *accumulate((b for _, b in whole), max)]  # the furthest end of the whole spans up to each
        cut = [s[1:3] for s in parts if not s[4] and reach[bisect_right(whole, (s[1], len(texts[i])))] < s[2]]
        found[i] = [s[:4] for s in parts if s[4]]
        again += [(i, a) for a in wide_starts(cut, len(texts[i]))]
    # as many characters at once as with narrow windows
    some = 1024 * WINDOW // WIDE
    for at in range(0, len(again), some):
        path, p = tagger.tags(np.concatenate([_windows(own[i], np.array([a]), WIDE) for i, a in again[at : at + some]]))
        for (i, a), tags, sures in zip(again[at : at + some], path, p):
            found[i] += [s[:4] for s in window_parts(tags, sures, a, len(texts[i])) if s[4]]
    out = []
    for text, spans, base, no in zip(texts, found, known, refused):
        usable = [s for s in spans_ok(spans, sure) if s[2] - s[1] >= LEAST_CHARS and MARK.search(text, s[1], s[2]) and all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append(reconciled([s for s in usable if not _vetoed(text, s[:3], no)]))
    return out


def spans_ok(spans: list[tuple[str, int, int, float]], sure: float) -> list[tuple[str, int, int, float]]:
    return [s for s in spans if s[3] >= sure]


# ---- training ---------------------------------------------------------------------------------


def variant(kind: str, value: str, draw: random.Random) -> str | None:
    """A way to write a value that the patterns do not read."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "card":
        return ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == "phone" and len(digits) >= 10:
        local = digits[-10:]
        return draw.choice((f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}"))
    if kind == "email":
        return draw.choice((value.replace("@", " @ "), value.replace("@", "(at)")))
    return None


def training_windows(texts: list[str], most: int = WINDOWS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: each text as it is, and once more with about half of its spans written as a variant."""
    draw, xs, ys = random.Random(seed), [], []
    for text in texts:
        spans, _ = pattern_spans(text)
        apart: list[tuple[str, int, int]] = []
        for s in sorted(spans, key=lambda s: (s[1], -s[2])):
            if not apart or s[1] >= apart[-1][2]:
                apart.append(s)
        for changed in (False, True) if apart else (False,):
            parts, tags, at = [], [], 0
            for kind, start, end in apart:
                value = text[start:end]
                value = (variant(kind, value, draw) or value) if changed and draw.random() < 0.5 else value
                parts += [text[at:start], value]
                tag = 1 + 2 * KINDS.index(kind)
                tags += [0] * (start - at) + [tag] + [tag + 1] * (len(value) - 1)
                at = end
            parts.append(text[at:])
            x = symbols("".join(parts))
            y = np.array(tags + [0] * (len(text) - at), np.int64)
            starts = window_starts(x)
            if len(starts):
                xs.append(_windows(x, starts))
                ys.append(_windows(y, starts))
    if not xs:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    # a tag that goes on from before the window begins there
    first = y[:, 0]
    y[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    order = np.random.default_rng(seed).permutation(len(x))[:most]
    return x[order], y[order]


def fit(docs: DataFrame, rows: int = DOCS, most_chars: int = MOST_CHARS, steps: int = STEPS) -> Tagger | None:
    """A tagger trained on a bounded sample of texts; none if no text of the sample has a span."""
    usable = docs.select("text").where(F.col("text").rlike(f"(?i){MARK.pattern}") & (F.length("text") <= most_chars)).withColumn("hash", F.xxhash64("text"))
    # hashes are chosen before texts are sent, so no task sends more than its share of the sample
    first = usable.select("hash").distinct().orderBy("hash").limit(rows)
    chosen = usable.join(F.broadcast(first), "hash").groupBy("hash").agg(F.min("text").alias("text"))
    texts = [r["text"] for r in sorted(chosen.collect())]
    x, y = training_windows(texts)
    return Tagger().fit(x, y, steps) if y.any() else None


# ---- documents --------------------------------------------------------------------------------


def _tagged(column: pa.Array, tagger: Tagger | None) -> Iterator[tuple[int, str, list, list]]:
    """Row, text, pattern spans and added spans of the rows that can have any."""
    marked = np.zeros(256, bool)
    marked[[*range(48, 58), 64]] = True
    small = np.arange(256) | 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))
    for at, _, data, offsets in slices(column):
        opens = np.flatnonzero(data[:-3] == 40)
        spelled = opens[(small[data[opens + 1]] == 97) & (small[data[opens + 2]] == 116) & (data[opens + 3] == 41)]
        rows = np.unique(np.searchsorted(offsets, np.concatenate((np.flatnonzero(marked[data]), spelled)), "right") - 1)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows]
        base, refused = zip(*map(checked_spans, texts)) if texts else ((), ())
        more = added_spans(tagger, texts, list(base), list(refused)) if tagger and texts else [[] for _ in texts]
        for i, text, b, m in zip(rows, texts, base, more):
            yield at + int(i), text, b, m


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def personal_data(docs: DataFrame, tagger: Tagger | None = None, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs`` (``doc_id``, ``text``).

    The numbers and the digest are of the patterns' spans; ``spans`` has all.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, **options))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = np.zeros((batch.num_rows, 5), np.int64)
            digest, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            for i, _, base, more in _tagged(batch.column("text"), shared.value):
                n[i] = [*(sum(s[0] == k for s in base) for k in KINDS), len(more)]
                digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined([*base, *more])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(4)), pa.array(digest), pa.array(spans), pa.array(n[:, 4])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"doc_id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, tagger: Tagger | None = None, **options) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind.

    ``n_chars``, where there is such a column, is counted anew. Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, **options))

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = None
            for i, text, base, more in _tagged(batch.column(place), shared.value):
                if base or more:
                    texts = texts or batch.column(place).to_pylist()
                    texts[i] = clean(text, [*base, *more])
            yield batch if texts is None else batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
