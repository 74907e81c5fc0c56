"""Toxicity: a linear sentence classifier, trained so that swapping identity terms does not move its score.

Sentences end at ``.!?`` or a line feed, or after 40 words. A sentence's logit is the sum of its words'
weights; a word's weight comes from hashed features, the word and its first bytes, and a word that repeats the one before it
counts once. A document is toxic if
any sentence is: its score is ``1 - prod(1 - p)`` over sentences (noisy or), which is also how document
labels train sentences. For every labelled sentence with an identity term, copies with the other terms of the
same group are made, and the squared difference of the two logits is added to the loss: a group's mention
alone cannot raise the score.

The fit uses a bounded sample: ``rows`` labelled documents a label, chosen by a hash, of ``most_chars`` characters at most.
Scoring covers every document and whole texts, and weighs each distinct word of a batch once.

A null or empty text scores as a text without any evidence. Null labels are not used. Without labelled rows of
both kinds every score is next to that of the only kind (0 if there are no labels). Repeated rows score alike.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, held_out, labelled_sample, slices, word_bounds, word_hashes

FOLDS, HELD_OUT = 4, 2
CUT = 0.3
ROWS = 1500
MOST_CHARS = 10_000
BITS = 18
PREFIXES = (3, 4, 5, 6, 8)
SENTENCE_WORDS = 40
STEPS = 150
PENALTY = 1.0
#: Bound of the fit: swapped sentences that the penalty is taken over.
SWAPS = 50_000

#: Terms that may stand for each other, by group.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
)
_GROUP = {term: group for group in IDENTITY_TERMS for term in group}
_TERM = re.compile(r"\b(" + "|".join(_GROUP) + r")\b")

_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, np.int64)
_STOP[list(b".!?\n")] = 1


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of each word, one column for the word and one for each length of its beginning; 2 ** BITS stands for none."""
    columns = [word_hashes(data, starts, ends)]
    for n in PREFIXES:
        columns.append(np.where(ends - starts >= n, word_hashes(data, starts, np.minimum(starts + n, ends)) ^ U(n * 0x9E3779B97F4A7C15 % 2**64), U(0)))
    out = np.column_stack([(c >> U(64 - BITS)).astype(np.int32) for c in columns])
    out[:, 1:][(ends - starts)[:, None] < np.array(PREFIXES)[None, :]] = 1 << BITS
    return out


def sentences(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every sentence, and the number of sentences before each row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    stop = np.cumsum(_STOP[data])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (stop[1:] != stop[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(place % SENTENCE_WORDS == 0)
    return first, np.searchsorted(first, before)


def _as_buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@dataclass
class Prepared:
    """Words of texts: features of the distinct ones, which one each is, whether it counts; first word of each sentence, sentences before each text."""

    distinct: np.ndarray
    which: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Prepared:
        starts, ends, before = word_bounds(data, offsets, _APART)
        first, rows = sentences(data, offsets, starts, before)
        _, once, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        counts = np.ones(len(which))
        counts[1:] = which[1:] != which[:-1]  # a word that repeats the one before it says no more
        counts[first] = 1
        return cls(features(data, starts[once], ends[once]), which, counts, first, rows)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0)
        return np.add.reduceat(weights[self.distinct].sum(axis=1)[self.which] * self.counts, self.first)

    def spread(self, slope: np.ndarray) -> np.ndarray:
        """The gradient by weights from that by sentence logits."""
        words = np.repeat(slope, np.diff(np.append(self.first, len(self.which)))) * self.counts
        words = np.bincount(self.which, words, len(self.distinct))
        return np.bincount(self.distinct.ravel(), np.repeat(words, self.distinct.shape[1]), (1 << BITS) + 1)


def swapped(text: str) -> list[tuple[str, str]]:
    """Each sentence of a text that names a group's term, with the same sentence about each other term of the group."""
    out = []
    for sentence in re.split(r"[.!?\n]+", text):
        for match in _TERM.finditer(sentence):
            for other in _GROUP[match.group()]:
                if other != match.group():
                    out.append((sentence, sentence[: match.start()] + other + sentence[match.end() :]))
    return out


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, penalty: float = PENALTY, ridge: float = 1e-4, rate: float = 0.15, least: int = 3, swaps: int = SWAPS) -> tuple[np.ndarray, float]:
    """Weights by feature and the constant, by Adam on the noisy-or loss, the swap penalty and a ridge.

    Of the swapped sentences, the ``swaps`` with the smallest hash count, whatever the label of their text.
    """
    own = Prepared.of(*_as_buffer(texts))
    pairs = heapq.nsmallest(swaps, (p for t in texts for p in swapped(t)), key=lambda p: (crc32("\0".join(p).encode()), p))
    left, right = (Prepared.of(*_as_buffer([p[k] for p in pairs])) for k in (0, 1))
    weights, bias = np.zeros((1 << BITS) + 1), -9.0
    text = np.repeat(np.arange(len(texts)), np.diff(own.before))
    each = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    # a feature has a weight only if enough toxic texts have it: what one text alone has would explain that text, and no other
    word = np.repeat(np.arange(len(own.first)), np.diff(np.append(own.first, len(own.which))))
    pairs_met = np.unique(text[word][labels[text[word]] == 1] * len(own.distinct) + own.which[labels[text[word]] == 1])
    met = np.unique((pairs_met // max(1, len(own.distinct)))[:, None] * (len(weights) + 1) + own.distinct[pairs_met % max(1, len(own.distinct))])
    shared = np.bincount(met % (len(weights) + 1), minlength=len(weights))[: len(weights)] >= least
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(own.logits(weights) + bias, -30, 30)))
        clean = np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
        slope = (each * pull)[text] * p
        change = own.spread(slope) + ridge * weights
        if pairs:  # a swap changes one word for another, so both sides have the same sentences
            gap = 2 * penalty / len(pairs) * (left.logits(weights) - right.logits(weights))
            change += left.spread(gap) - right.spread(gap)
        change *= shared
        change[-1] = 0
        for name, g in (("w", change), ("b", slope.sum())):
            if name == "w":
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
                weights[-1] = 0
            else:
                mb, vb = 0.9 * mb + 0.1 * g, 0.99 * vb + 0.01 * g * g
                bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return weights, float(bias)


def row_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, shift: float = 0.0) -> np.ndarray:
    """The noisy or over each row's sentences; ``shift`` is added to its log odds. A row without words counts as one sentence without weight."""
    own = Prepared.of(data, offsets)
    clean = -np.log1p(np.exp(np.clip(own.logits(weights) + bias, -30, 30)))
    total = np.concatenate(([0.0], np.cumsum(clean)))
    log_clean = np.where(np.diff(own.before) > 0, np.diff(total[own.before]), -np.log1p(np.exp(bias)))
    odds = np.log(np.maximum(-np.expm1(log_clean), 1e-300)) - log_clean + shift
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, cut: float = CUT, rows: int = ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``toxic``) is used only for rows that are not held out.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id"), folds, fold))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    chosen = labelled_sample(docs, known, rows).select("doc_id", text, "label").where(F.length("text").between(1, most_chars))
    sample = sorted((r["label"], r["doc_id"], r["text"]) for r in chosen.collect())
    toxic, clean = (n if any(r[0] == label for r in sample) else 0 for label, n in ((1, toxic), (0, clean)))
    if toxic and clean:
        # the fit weighs both labels alike; scores go a part of the way to their true shares, as the ridge keeps them low already
        weights, bias = fit([r[2] for r in sample], np.array([r[0] for r in sample]))
        shift = float(np.log(toxic / clean)) / 4
    else:
        weights, bias, shift = np.zeros((1 << BITS) + 1), -0.6931471805599453 if toxic else -30.0, 30.0 if toxic else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB, whatever the corpus
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for at, to, data, offsets in slices(batch.column("text")):
                scores[at:to] = row_scores(data, offsets, shared.value, bias, shift)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select("doc_id", text).mapInArrow(run, f"doc_id {key}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
