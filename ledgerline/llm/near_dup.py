"""N-gram Jaccard join: texts whose sets of word five-grams overlap by 0.8 or more.

1. One pass over the texts folds each to the fingerprint of its n-gram set, and a MinHash signature cut
   into bands. Texts of equal sets form one *node*; only nodes go on, so exact copies cost nothing more.
2. Band hashes are shuffled; nodes that share a bucket are candidates. Buckets with the same members
   are kept once.
3. The n-gram sets of candidates alone are made again and dealt to their buckets. A large bucket (many rows, or many n-grams in
   them) is cut into blocks, and each pair of blocks is one unit of work, so no task holds a large group, and no
   pair leaves a task: a unit returns a number of links for each node and a spanning forest of them.
4. A pair that shares several buckets is counted in the smallest one.

Words are runs without ``[\\x20\\x09-\\x0D]``, lower case. A text of one to four words has one n-gram, all
its words. Null and empty texts have none: they have no links and are a class of their own each.
Rows that are repeated are copies of each other. Null ids are kept, and may share a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, components, mix, shingle_hashes, slices, staged, word_bounds, word_hashes

N_GRAM = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
ROWS = 5
BLOCK = 512
BLOCK_GRAMS = 1 << 20


def banding(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS) -> tuple[int, int]:
    """Bands and rows a band, so that a pair just at ``similarity`` shares a bucket with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def _band_hashes(grams: np.ndarray, to: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each row and band, from the minima of ``bands * rows`` permutations over the row's n-grams."""
    full = np.flatnonzero(np.diff(to))
    out = np.zeros((len(to) - 1, bands), np.uint64)
    factors = np.random.default_rng(5).integers(1, 1 << 63, (bands, rows, 2), dtype=np.uint64) * U(2) + U(1)
    for band in range(bands):
        for times, plus in factors[band]:
            low = np.minimum.reduceat(grams * times + plus, to[full])
            out[full, band] = mix(out[full, band] * U(31) + low + U(band))
    return out


def _gram_rows(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, end, data, offsets in slices(column):
        starts, ends, before = word_bounds(data, offsets)
        yield at, end, *shingle_hashes(word_hashes(data, starts, ends), before, n)


def _node(distinct: np.ndarray) -> bytes:
    """A 128-bit fingerprint of a set of n-grams."""
    a, b = int(mix(distinct).sum()), int(mix(distinct ^ U(0xA5A5A5A5A5A5A5A5)).sum())
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def signatures(docs: DataFrame, n: int = N_GRAM, bands: int = 0, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_hash, node, bands`` of every row; node and bands are null for a text without words."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, marks = [], []
            for _, _, grams, to in _gram_rows(batch.column("text"), n):
                hashes = _band_hashes(grams, to, bands, rows).view(np.int64)
                for i in range(len(to) - 1):
                    own = grams[to[i] : to[i + 1]]
                    nodes.append(_node(np.unique(own)) if len(own) else None)
                    marks.append(hashes[i] if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "bands"],
            )

    return _lowered(docs).mapInArrow(run, f"doc_id {key}, text_hash long, node binary, bands array<long>")


def _lowered(docs: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """``node, grams, keys, weight`` of candidate rows; grams are distinct and sorted."""

    def run(batches):
        for batch in batches:
            sets = []
            for _, _, grams, to in _gram_rows(batch.column("text"), n):
                sets += [np.unique(grams[to[i] : to[i + 1]]).view(np.int64) for i in range(len(to) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64())), batch.column("keys"), batch.column("weight")],
                names=["node", "grams", "keys", "weight"],
            )

    return docs.mapInArrow(run, "node binary, grams array<long>, keys array<long>, weight long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: n-grams that only one row holds are left out, the rest multiplied in chunks."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    column, out = column[gram], np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 4096):
        here = (column >= at) & (column < at + 4096)
        part = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        part[row[here], column[here] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _links(key: int, lo: int, hi: int, rows: list[dict], similarity: float) -> Iterator[tuple[bytes, int, bytes]]:
    """``node, links, root`` for the linked nodes of one bucket or pair of blocks."""
    rows = list({r["node"]: r for r in rows}.values())
    if len(rows) < 2:
        return
    sizes = np.array([len(r["grams"]) for r in rows])
    both = _overlaps([np.asarray(r["grams"]) for r in rows])
    union = sizes[:, None] + sizes[None, :] - both
    near = np.triu(both >= similarity * union - 1e-9, 1)
    if lo != hi:  # pairs inside one block belong to another unit
        block = np.array([r["block"] for r in rows])
        near &= block[:, None] != block[None, :]
    pairs = np.argwhere(near)
    first = [np.asarray(r["keys"]) for r in rows]
    pairs = [(i, j) for i, j in pairs if np.intersect1d(first[i], first[j])[0] == key]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = np.zeros(len(rows), np.int64)
    for i, j in pairs:
        links[i] += rows[j]["weight"]
        links[j] += rows[i]["weight"]
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    for i in np.flatnonzero(links):
        yield rows[i]["node"], int(links[i]), rows[root(i)]["node"]


def _verified(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``node, links, root``: links of each node and the edges of a spanning forest, from whole n-gram sets.

    The rows of one unit are consecutive in their partition; a unit has two blocks at most.
    """
    members = sets.select("node", F.size("grams").alias("size"), F.explode("keys").alias("key"))
    needed = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    large = members.groupBy("key").agg(needed.alias("blocks")).where("blocks > 1")
    # only names of rows meet by bucket; their sets follow by row
    dealt = members.join(large, "key", "left").select("node", "key", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(node, key), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = sets.join(dealt, "node").select("node", "grams", "keys", "weight", "key", "block", "lo", "hi")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        unit, held = None, []

        def done():
            found = list(_links(*unit, held, similarity)) if unit else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.binary()))], names=["node", "links", "root"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "node", "weight", "block")]
            for i, (key, lo, hi, node, weight, at) in enumerate(zip(*columns)):
                if (key, lo, hi) != unit:
                    yield from done()
                    unit, held = (key, lo, hi), []
                held.append({"node": node, "weight": weight, "block": at, "grams": batch.column("grams")[i].values.to_numpy(), "keys": batch.column("keys")[i].values.to_numpy()})
        yield from done()

    return rows.mapInArrow(run, "node binary, links long, root binary")


def _classes(docs: DataFrame, n: int, similarity: float, recall: float, rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (``doc_id, text_hash, node``), and of each node its ids, links, and its class's first row (``keep``)."""
    bands, rows = banding(similarity, recall, rows)
    signed = staged(signatures(docs.select("doc_id", "text"), n, bands, rows))
    # a null id counts as larger than any, so a class has a null id only if all its rows have
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = staged(signed.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min(order).alias("pick"), F.first("bands").alias("bands")))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("s")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    picks = banded.join(buckets, "key").groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    picks = picks.join(nodes.select("node", "weight", "pick"), "node").select("node", "weight", "keys", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("pick_hash"))
    found = _lowered(docs).join(picks, F.col("doc_id").eqNullSafe(F.col("pick_id")) & (F.col("text_hash") == F.col("pick_hash")))
    # rows that are repeated give a node several times; its n-grams are the same each time
    sets = staged(_gram_sets(found.select("node", "text", "keys", "weight"), n))
    linked = staged(_verified(sets, similarity, block))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = nodes.select("node", "pick", "weight").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = groups.groupBy("root").agg(F.min("pick").alias("keep"))
    classes = groups.join(smallest, "root").select("node", "keep", F.col("pick.doc_id").alias("exact_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_hash", "node"), classes


def jaccard_join(docs: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, exact_id, n_links``, one row for each row of ``docs`` (``doc_id``, ``text``).

    ``class_id``: smallest doc_id among the texts that links connect; ``exact_id``: smallest with the same
    n-gram set; ``n_links``: the number of other rows with a similarity of ``similarity`` or more.
    Pairs of equal sets are always found, others with a probability of ``recall`` at least.
    """
    signed, classes = _classes(docs, n, similarity, recall, rows, block)
    return signed.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"),
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest id (then text hash) stays, once.

    Rows without words all stay.
    """
    signed, classes = _classes(docs, n, similarity, recall, rows, block)
    repeats = signed.where("node is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("repeats"))
    keep = classes.select("keep.doc_id", "keep.text_hash").distinct()
    keep = keep.join(repeats, keep["doc_id"].eqNullSafe(repeats["doc_id"]) & (keep["text_hash"] == repeats["text_hash"])).select(keep["doc_id"].alias("_id"), keep["text_hash"].alias("_hash"), "repeats")
    empty = signed.where("node is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(1).cast("long").alias("repeats")).distinct()
    found = docs.withColumn("_text_hash", F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))).join(keep.union(empty), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    once = found.where("repeats > 1").dropDuplicates(["doc_id", "_text_hash"])
    return found.where("repeats = 1").union(once).select(*docs.columns)
