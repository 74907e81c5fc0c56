"""Hard-negative mining with angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. The angle between two rows is at least
the difference of their angles to a reference, and at most the sum (or what the sum leaves of a full
turn); the tightest of these over all references gives an interval of cosines, and with the norms an interval
of scores, widened by more than the arithmetic can be wrong. An integer score is computed only where
the interval reaches into a window that is asked for:

1. An anchor's positives: rows of its label, in blocks of that label. A row whose upper bound is below the
   k-th best lower bound of its block cannot be among the block's k best.
2. Its negatives: rows of other labels whose score is within shares of a positive's score. Blocks hold rows
   that are nearest to the same reference. A block of anchors meets a block of rows only if the interval
   between their ranges of angles and norms reaches a window of those anchors; then rows are filtered alike.

What leaves a pair of blocks is a bounded number of rows an anchor; the best of all blocks are ranked by anchor. The
references are rows of a bounded sample, each the direction within ``COVER`` of most sampled rows not yet
covered. They decide how much is skipped, never what is found: results are exact for any references. Where
vectors point everywhere alike, as random ones do, intervals are wide and little is skipped.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths are
compared as if the shorter one went on with zeros; zero and empty vectors score 0 with all. Other rows are
those with another id. Of rows that share an anchor's id, the one with the smallest label, then vector, asks;
as candidates, repeated rows are ranked each. Ties go to the smaller id. Columns that are not named are
not read. Scores beyond 64 bits are undefined. Empty tables, and anchors without positives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import staged
from ledgerline.llm.topk import _matrix, _same_width, whole_numbers

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
REFERENCES, SAMPLE, COVER = 8, 512, np.pi / 4
BLOCK, ANCHOR_BLOCK = 8192, 8192
#: More than an angle of rounded vectors can be wrong (the arc cosine turns an error e near 1 into its root), in radians.
SLACK = 1e-5
_CELLS = 1 << 19


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point while every sum is exact there."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 2**53 else a @ b.T


def choose_references(vectors: np.ndarray, count: int = REFERENCES, cover: float = COVER) -> np.ndarray:
    """Up to ``count`` unit vectors among the rows, each within ``cover`` of most rows that none before it covers."""
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    near, left, chosen = units @ units.T >= np.cos(cover), np.ones(len(units), bool), []
    while len(chosen) < count and left.any():
        chosen.append(int((near & left).sum(axis=1).argmax()))
        left &= ~near[chosen[-1]]
    return units[chosen] if chosen else np.ones((1, max(1, vectors.shape[1])))


def angles_to(references: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference; a zero vector is said to stand at right angles, its norm makes all bounds 0."""
    vectors, references = _same_width(vectors.astype(np.float64), references)
    norms = np.linalg.norm(vectors, axis=1)
    lengths = np.linalg.norm(references, axis=1)
    cosines = (vectors @ references.T) / (np.where(norms > 0, norms, 1)[:, None] * lengths)
    return norms, np.arccos(np.clip(cosines, -1, 1))


def score_bounds(norms: np.ndarray, angles: np.ndarray, other_norms: np.ndarray, other_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, from stored norms and angles alone."""
    least = np.zeros((len(norms), len(other_norms)))
    most = np.full_like(least, np.pi)
    for a, b in zip(angles.T, other_angles.T):
        np.maximum(least, np.abs(a[:, None] - b[None, :]), out=least)
        total = a[:, None] + b[None, :]
        np.minimum(most, total, out=most)
        np.minimum(most, 2 * np.pi - total, out=most)
    both = norms[:, None] * other_norms[None, :]
    spare = 1 + 1e-9 * both
    return np.cos(np.minimum(most + SLACK, np.pi)) * both - spare, np.cos(np.maximum(least - SLACK, 0)) * both + spare


def _unpack(rows: pa.Table) -> dict[str, np.ndarray]:
    rows = rows.sort_by("vec_id")
    angles = rows["angles"].combine_chunks()
    return {
        "id": rows["vec_id"].to_numpy(),
        "e": _matrix(rows["e"]),
        "norm": rows["norm"].to_numpy(),
        "angles": angles.flatten().to_numpy().reshape(len(rows), -1),
    }


def _chunks(a: dict, b: dict, wanted) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors in chunks: their slice, which pairs ``wanted(slice, lower, upper)`` keeps, columns with any, and the scores of those."""
    a["e"], b["e"] = _same_width(a["e"], b["e"])
    step = max(1, _CELLS // max(1, len(b["id"])))
    for at in range(0, len(a["id"]), step):
        part = slice(at, at + step)
        lower, upper = score_bounds(a["norm"][part], a["angles"][part], b["norm"], b["angles"])
        kept = wanted(part, lower, upper)
        columns = np.flatnonzero(kept.any(axis=0))
        if len(columns):
            yield part, kept[:, columns], columns, _products(a["e"][part], b["e"][columns])


def _best(scores: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores inside; equal scores in the order they stand (by id)."""
    places = np.flatnonzero(inside)
    if len(places) > k:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def best_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of one block, all of the anchors' label, for each anchor."""
    a, b = _unpack(anchors), _unpack(rows)
    found: list[tuple[int, int, int]] = []

    def wanted(part, lower, upper):
        own = a["id"][part][:, None] == b["id"][None, :]
        lower[own] = upper[own] = -np.inf
        n = lower.shape[1]
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(lower), -np.inf)
        return (upper >= kth[:, None]) & ~own

    for part, kept, columns, scores in _chunks(a, b, wanted):
        for i, anchor in enumerate(a["id"][part]):
            found += [(int(anchor), int(b["id"][columns[j]]), int(scores[i, j])) for j in _best(scores[i], kept[i], k)]
    columns = list(zip(*found)) or [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score"), columns)})


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole score between two per cents of each score."""
    return -((-low * scores) // 100), (high * scores) // 100


def best_negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the ``k`` best rows of one block in the positive's window, of other labels."""
    a, b = _unpack(anchors), _unpack(rows)
    anchors, rows = anchors.sort_by("vec_id"), rows.sort_by("vec_id")
    label, labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
    positives = [[(p["positive_rank"], p["positive_id"], p["positive_score"]) for p in own] for own in anchors["positives"].to_pylist()]
    spans = [windows(np.array([p[2] for p in own], np.int64), low, high) for own in positives]
    found: list[tuple] = []

    def wanted(part, lower, upper):
        kept = np.zeros(lower.shape, bool)
        for i, (least, most) in enumerate(spans[part]):
            for x, y in zip(least, most):
                kept[i] |= (upper[i] >= x) & (lower[i] <= y)
        return kept & (label[part][:, None] != labels[None, :])

    for part, kept, columns, scores in _chunks(a, b, wanted):
        for i, anchor in enumerate(a["id"][part]):
            for (rank, positive, score), x, y in zip(positives[part][i], *spans[part][i]):
                for j in _best(scores[i], kept[i] & (scores[i] >= x) & (scores[i] <= y), k):
                    found.append((int(anchor), rank, positive, score, int(b["id"][columns[j]]), int(scores[i, j])))
    columns = list(zip(*found)) or [[]] * 6
    names = ("anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score")
    return pa.table({n: pa.array(c, pa.int32() if n == "positive_rank" else pa.int64()) for n, c in zip(names, columns)})


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``vec_id, label, asks, e`` with ``norm``, ``angles`` and ``cell``, the nearest reference."""

    def run(batches):
        for batch in batches:
            vectors = _matrix(pa.chunked_array([batch.column("e")]))
            norms, angles = angles_to(references, vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1) * angles.shape[1], pa.int32()), pa.array(angles.ravel()))
            columns = [*batch.columns, pa.array(norms), lists, pa.array(angles.argmin(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "norm", "angles", "cell"])

    return rows.mapInArrow(run, "vec_id long, label long, asks boolean, e array<long>, norm double, angles array<double>, cell int")


def _dealt(parts: Column | int, *salt) -> Column:
    return F.pmod(F.xxhash64(*salt, "vec_id", "e"), parts).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def _positives(stored: DataFrame, asking: DataFrame, k: int, block: int, anchor_block: int) -> DataFrame:
    """``anchor_id, positive_rank, positive_id, positive_score``: blocks of a label's anchors meet blocks of its rows."""
    sizes = stored.groupBy("label").agg(F.ceil(F.count("*") / block).alias("parts"))
    asked = asking.groupBy("label").agg(F.ceil(F.count("*") / anchor_block).alias("anchor_parts"))
    sizes = sizes.join(asked, "label")
    keep = ["label", "vec_id", "e", "norm", "angles"]
    rows = stored.join(sizes, "label").select(*keep, _dealt(F.col("parts")).alias("part"), _each(F.col("anchor_parts")).alias("anchor_part"))
    anchors = asking.join(sizes, "label").select(*keep, _dealt(F.col("anchor_parts"), F.lit("anchor")).alias("anchor_part"), _each(F.col("parts")).alias("part"))
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_positives(left, right, k) if left.num_rows and right.num_rows else empty

    keys = ["label", "anchor_part", "part"]
    found = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("positive_rank", rank).where(F.col("positive_rank") <= k).select("anchor_id", "positive_rank", "positive_id", "positive_score")


def _ranges(rows: DataFrame, key: str, references: int, *more: Column) -> DataFrame:
    """Least and largest norm and angle to each reference of the rows of each block."""
    low, high = ([f(F.col("angles")[i]) for i in range(references)] for f in (F.min, F.max))
    return rows.groupBy(key).agg(F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"), F.array(*low).alias("low"), F.array(*high).alias("high"), *more)


def _meeting(anchor_blocks: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """``anchor_block, block`` where scores between the two blocks can lie in a window of the anchors.

    One narrow row a block on either side: the first has the numbers of all blocks, and each is looked up.
    """
    a = anchor_blocks.select(F.col("anchor_block"), *[F.col(c).alias(f"a_{c}") for c in ("norm_low", "norm_high", "low", "high")], "least", "most", _each(F.lit(n_blocks)).alias("block"))
    gaps = F.zip_with(F.zip_with("a_low", "high", lambda x, y: x - y), F.zip_with("low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    sums = F.zip_with("a_high", "high", lambda x, y: x + y)
    turns = F.zip_with("a_low", "low", lambda x, y: F.lit(2 * np.pi) - x - y)
    pairs = a.join(blocks, "block").select(
        "anchor_block",
        "block",
        "least",
        "most",
        F.cos(F.greatest(F.array_max(gaps) - SLACK, F.lit(0.0))).alias("upper_cos"),
        F.cos(F.least(F.array_min(F.zip_with(sums, turns, lambda x, y: F.least(x, y))) + SLACK, F.lit(float(np.pi)))).alias("lower_cos"),
        (F.col("a_norm_low") * F.col("norm_low")).alias("small"),
        (F.col("a_norm_high") * F.col("norm_high")).alias("large"),
    )
    spare = 1 + F.lit(1e-9) * F.col("large")
    upper = F.col("upper_cos") * F.when(F.col("upper_cos") > 0, F.col("large")).otherwise(F.col("small")) + spare
    lower = F.col("lower_cos") * F.when(F.col("lower_cos") > 0, F.col("small")).otherwise(F.col("large")) - spare
    return pairs.where((upper >= F.col("least")) & (lower <= F.col("most"))).select("anchor_block", "block")


def _negatives(stored: DataFrame, asking: DataFrame, positives: DataFrame, k: int, low: int, high: int, references: int, block: int, anchor_block: int) -> DataFrame:
    lists = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"))
    ready = asking.join(lists, "vec_id").select("vec_id", "label", "e", "norm", "angles", "cell", "positives")

    def numbered(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row a reference
        parts = [max(1, -(-counts.get(c, 0) // size)) for c in range(references)]
        first = np.concatenate(([0], np.cumsum(parts)))
        pick = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
        return rows.withColumn(name, (pick(first[:-1]) + _dealt(pick(parts), F.lit(name))).cast("int")), int(first[-1])

    rows, n_blocks = numbered(stored, block, "block")
    anchors, _ = numbered(ready, anchor_block, "anchor_block")
    scores = F.col("positives.positive_score")
    least, most = F.min(F.array_min(scores) * low / 100), F.max(F.array_max(scores) * high / 100)
    meeting = staged(_meeting(_ranges(anchors, "anchor_block", references, least.alias("least"), most.alias("most")), _ranges(rows, "block", references), n_blocks))
    keys = ["anchor_block", "block"]
    left = anchors.join(meeting, "anchor_block").select(*keys, "vec_id", "label", "e", "norm", "angles", "positives")
    right = rows.join(meeting, "block").select(*keys, "vec_id", "label", "e", "norm", "angles")
    names = {"anchor_id": pa.int64(), "positive_rank": pa.int32(), "positive_id": pa.int64(), "positive_score": pa.int64(), "negative_id": pa.int64(), "negative_score": pa.int64()}
    empty = pa.table({n: pa.array([], t) for n, t in names.items()})

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return best_negatives(mine, theirs, k, low, high) if mine.num_rows and theirs.num_rows else empty

    schema = "anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    references: int = REFERENCES,
    sample: int = SAMPLE,
    block: int = BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    For each row of ``vectors`` (``vec_id``, ``embedding``, whole-number ``label``) where ``anchors`` holds, its best
    ``positives`` rows of the same label, and for each of these the best ``negatives`` rows of other labels with a
    score of ``low`` to ``high`` per cent of the positive's. ``references`` are chosen from ``sample`` rows.
    """
    given = F.col(label) if isinstance(label, str) else label
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), given.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), whole_numbers("embedding", scale).alias("e"))
    usable = usable.where("vec_id is not null and label is not null and e is not null")
    picked = usable.select("e", F.xxhash64(F.lit("reference"), "vec_id", "e").alias("h")).orderBy("h").limit(sample).select("e").toArrow()["e"]
    chosen = choose_references(_matrix(picked), references)
    stored = staged(with_angles(usable, chosen))
    one = stored.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "e", "norm", "angles", "cell")).alias("row"))
    asking = staged(one.select("vec_id", "row.*"))
    best = staged(_positives(stored, asking, positives, block, anchor_block))
    found = _negatives(stored, asking, best, negatives, low, high, len(chosen), block, anchor_block)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def noisy_label() -> Column:
    """The label that the query mines by: that of every seventh id is one further."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


#: The same in SQL, for ids divisible by 50 and the labels above.
HARD_NEGATIVES_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
    FROM scored WHERE same QUALIFY positive_rank <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
