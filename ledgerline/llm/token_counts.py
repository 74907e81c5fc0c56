"""Token counts: greedy longest-match word pieces, counted by a linear automaton that builds no piece.

The automaton is the vocabulary's byte trie. A node that cannot go on with the next byte follows its failure link: to
the node that stands for what is left after the greedy pieces of the node's bytes are taken off. How many
these are is stored with the node, so a byte is read once and counting is an addition.

A word is a run without ``[\\x20\\x09-\\x0D]``; it is matched with one space before it, so pieces that begin a
word and pieces inside one are told apart. Every byte is a piece of this vocabulary, so any word can be cut.
A batch's distinct words walk the automaton side by side in numpy.

A null or empty text has no words and no tokens. Rows come back one for one, repeated or not.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices, word_bounds, word_hashes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of lines with a piece in base64 and its id."""
    import base64

    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class Automaton:
    """Edges ``node * 256 + byte`` in order with their targets; failure link and popped pieces of every node. Node 0 is the root."""

    edges: np.ndarray
    targets: np.ndarray
    failure: np.ndarray
    popped: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Automaton:
        if len({p for p in pieces if len(p) == 1}) < 256:
            raise ValueError("every single byte must be a piece")
        following: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in following[node]:
                    following[node][byte] = len(following)
                    following.append({})
                    whole.append(False)
                node = following[node][byte]
            whole[node] = True
        failure, popped = [0] * len(following), [0] * len(following)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in following[parent].items():
                queue.append(node)
                if whole[node]:
                    popped[node] = 1
                    continue
                rest, taken = failure[parent], popped[parent]
                while byte not in following[rest]:
                    taken += popped[rest]
                    rest = failure[rest]
                failure[node], popped[node] = following[rest][byte], taken
        edges = sorted((node * 256 + byte, target) for node, after in enumerate(following) for byte, target in after.items())
        keys, targets = (np.array(x, np.int64) for x in zip(*edges))
        return cls(keys, targets, np.array(failure, np.int64), np.array(popped, np.int64))

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start:end]`` with a space before it."""
        total = np.zeros(len(starts), np.int64)
        if not len(starts):
            return total
        data = np.append(data, 0)
        alive = np.arange(len(starts))
        node = np.full(len(starts), self._go(np.zeros(1, np.int64), np.full(1, 32))[0])
        at = starts.copy()
        while len(alive):
            over = at >= ends[alive]
            target = np.where(over, -1, self._go(node, data[np.minimum(at, len(data) - 1)]))
            on = target >= 0
            stuck = ~on
            total[alive[stuck]] += self.popped[node[stuck]]
            node = np.where(on, target, self.failure[node])
            at = at + on
            keep = ~(over & (node == 0))
            if not keep.all():
                alive, node, at = alive[keep], node[keep], at[keep]
        return total

    def _go(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], -1)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row of ``docs`` (``doc_id``, ``text``).

    The automaton is built once and broadcast; its size is bounded by the vocabulary.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton.of(read_vocabulary(vocabulary or default_vocabulary())))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            words, tokens = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for at, to, data, offsets in slices(batch.column("text")):
                starts, ends, before = word_bounds(data, offsets)
                _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                each = automaton.value.counts(data, starts[first], ends[first])[which]
                running = np.concatenate(([0], np.cumsum(each)))
                words[at:to] = np.diff(before)
                tokens[at:to] = np.diff(running[before])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {key}, n_words long, n_tokens long")
