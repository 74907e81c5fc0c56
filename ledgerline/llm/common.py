"""What the operators share: staged tables, text buffers in numpy, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import materialize

SLICE_BYTES = 2 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder of ``spark.checkpoint.dir``: computed once, safe from lost executors."""
    return materialize(df)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the key as text falls into the fold; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, label`` of ``rows`` labelled documents a label, the first in the order of a hash of the id.

    ``known`` has ``doc_id, label``. Ids are chosen before any text is read, so what is broadcast is bounded
    by ``rows``, and no text is shuffled.
    """
    order = (F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
    chosen = [known.where(F.col("label") == label).orderBy(*order).limit(rows) for label in (0, 1)]
    ids = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "label")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


# ---- text in numpy ----------------------------------------------------------------------------


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of about ``most`` bytes, at least one row each.

    Gives first row, row after the last, the run's UTF-8 bytes, and row offsets into them. Null is empty.
    """
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (one more at the end).

    Words are runs of bytes that are not in ``space``: ``[^\\x20\\x09-\\x0D]+``, if nothing else is given.
    """
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & first[:-1]) if len(data) else np.zeros(0, np.int64)
    after = np.concatenate((~inside[1:], [True])) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


_BYTE = _constants(256, 11)
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, from one running sum over all bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("down", _BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each row, and the number of runs before each row.

    A row of fewer words has one run of all its words; a row without words has none.
    """
    counts = np.diff(before)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(runs)))
    row = np.repeat(np.arange(len(runs)), runs)
    start = before[:-1][row] + np.arange(to[-1]) - to[:-1][row]
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out = out * _BASE + np.where(start + k < before[1:][row], padded[start + k], U(0))
    return mix(out + np.minimum(counts, n)[row].astype(np.uint64)), to


# ---- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node (``root``) of the component of every ``node`` of undirected edges (``a``, ``b``).

    Large-star and small-star steps in turn until no edge changes; each round is one staged table, so a
    round's plan never contains the one before. Only two numbers a round reach the driver.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("the components did not settle")
