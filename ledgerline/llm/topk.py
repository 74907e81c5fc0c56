"""Exact top-k by inner product without random access (NRA).

Candidates are dealt into blocks. A block keeps one list a dimension, its components sorted by magnitude.
For a block of queries all lists are read from the top in steps; a component not yet read is no larger
than the last one read, which bounds every score from below and above. When only few candidates have an
upper bound that reaches a query's k-th best lower bound, nobody outside can qualify any more: reading
stops for that query and the scores of those few are resolved. At the last step all is read, so ties and
copies in any number end in exact scores too. The best k of each block are then ranked by key.

All arithmetic is on whole numbers: in floating point as long as every sum is exact there, else in 64-bit
integers (sums beyond those are undefined).

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors of
different lengths are compared as if the shorter one went on with zeros. A query is not its own
candidate, nor is any row with its id; rows that are repeated as candidates are ranked each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
DEPTHS = (0.5, 0.7, 0.8, 0.9, 1.0)
FEW = 0.03
SCHEMA = "query_id long, vec_id long, score long"


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the longest."""
    lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS, few: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of one block of candidates for each query: query ids, candidate ids, scores."""
    queries, vectors = _same_width(queries, vectors)
    n, width = vectors.shape
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width * 2
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    # the lists: position of every candidate in each, and the magnitudes in their order
    order = np.argsort(-np.abs(vectors), axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    magnitude = np.take_along_axis(np.abs(vectors), order, axis=0)

    found: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for depth in depths:
        read = max(1, int(np.ceil(n * depth)))
        seen = place < read
        q = queries[active].astype(kind)
        known = q @ np.where(seen, vectors, 0).astype(kind).T
        rest = np.abs(q) @ np.where(seen, 0, magnitude[read - 1]).astype(kind).T
        own = query_ids[active][:, None] == ids[None, :]
        lower, upper = known - rest, known + rest
        lowest = np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf
        lower[own] = upper[own] = lowest
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), lowest, lower.dtype)
        inside = (upper >= kth[:, None]) & ~own
        done = inside.sum(axis=1) <= max(2 * k, few * n) if read < n else np.ones(len(active), bool)
        row, column = np.nonzero(inside[done])
        found.append((active[done][row], column))
        active = active[~done]
        if not len(active):
            break

    rows, columns = (np.concatenate(x) for x in zip(*found))
    scores = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 16):  # what is left of the lists, for the survivors alone
        part = slice(at, at + (1 << 16))
        scores[part] = np.einsum("ij,ij->i", queries[rows[part]], vectors[columns[part]])
    best = np.lexsort((ids[columns], -scores, rows))
    rows, columns, scores = rows[best], columns[best], scores[best]
    first = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(queries)))))
    top = np.arange(len(rows)) - first[rows] < k
    return query_ids[rows[top]], ids[columns[top]], scores[top]


def whole_numbers(embedding: str, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as a long; null for a vector that takes no part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id``, ``embedding``) where ``queries`` holds its best ``k`` others.

    Every block of queries meets every block of candidates, each pair of blocks in a task of its own; what
    leaves a pair is ``k`` rows a query.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), queries.alias("asks"), whole_numbers("embedding", scale).alias("e")).where("vec_id is not null and e is not null")
    count = usable.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    blocks, query_blocks = (max(1, -(-n // size)) for n, size in ((count["n"], candidate_block), (count["asks"], query_block)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    query = F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(query_blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = usable.select("vec_id", "e", block.alias("block"), each(query_blocks).alias("query_block"))
    asking = usable.where("asks").dropDuplicates(["vec_id", "e"]).select("vec_id", "e", query.alias("query_block"), each(blocks).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            columns = search_block(left["vec_id"].to_numpy(), _matrix(left["e"]), right["vec_id"].to_numpy(), _matrix(right["e"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ["query_block", "block"]
    best = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL for queries whose id is divisible by 20.
TOP_K_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
