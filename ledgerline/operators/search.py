"""Sorted pages, counts and lists over active transactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PUBLIC_TRANSACTION_COLUMNS
from ..session import new_step_folder
from .criteria import Criteria, active, criteria_filter

DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 100
DEFAULT_SORT = (("date", "desc"), ("id", "desc"))
Sort = Sequence[tuple[str, str]]


def public_columns(tx: DataFrame) -> DataFrame:
    """The columns shown to users: no deletion marks, no import link."""
    return tx.select(*PUBLIC_TRANSACTION_COLUMNS)


def sort_columns(sort: Sort) -> list[Column]:
    """Sort keys over the allowed fields; NULL counts as the largest value, id breaks ties."""
    bad = [name for name, _ in sort if name not in PUBLIC_TRANSACTION_COLUMNS]
    if bad:
        allowed = ", ".join(PUBLIC_TRANSACTION_COLUMNS)
        raise ValueError(f"Unsupported sort field: {bad[0]}. Allowed sort fields: {allowed}")
    keys = [
        F.col(name).desc_nulls_first() if way == "desc" else F.col(name).asc_nulls_last()
        for name, way in sort
    ]
    if "id" not in [name for name, _ in sort]:
        keys.append(F.col("id").asc())
    return keys


def page_size(size: int | None, most: int = MAX_PAGE_SIZE) -> int:
    """The size asked for, or the default; a size above ``most`` is an error, never cut."""
    wanted = DEFAULT_PAGE_SIZE if size is None else size
    if not 1 <= wanted <= most:
        raise ValueError(f"page size must be from 1 to {most}")
    return wanted


def search_page(
    tx: DataFrame,
    c: Criteria | None,
    page: int = 0,
    size: int | None = None,
    sort: Sort = DEFAULT_SORT,
    most: int = MAX_PAGE_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """One page of matching active rows, and a one-row frame of page metadata.

    The page is a top-k (each task keeps ``offset + size`` rows), not a full sort. For deep paging
    use ``search_after``, or ``rank_hits`` for pages by number.
    """
    if page < 0:
        raise ValueError("page must be >= 0")
    size = page_size(size, most)
    hits = criteria_filter(active(tx), c)
    rows = public_columns(hits).orderBy(*sort_columns(sort)).offset(page * size).limit(size)
    return rows, page_metadata(hits, page, size)


def page_metadata(hits: DataFrame, page: int, size: int) -> DataFrame:
    return _metadata_of(hits.agg(F.count("*").alias("total_elements")), page, size)


def _metadata_of(totals: DataFrame, page: int, size: int) -> DataFrame:
    total = F.col("total_elements")
    pages = F.ceil(total / size).cast("bigint")
    return totals.select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        F.greatest(F.lit(0), F.least(F.lit(size), total - page * size))
        .cast("bigint")
        .alias("number_of_elements"),
        total,
        pages.alias("total_pages"),
        F.lit(page == 0).alias("first"),
        (F.lit(page + 1) >= pages).alias("last"),
    )


@dataclass(frozen=True)
class RankedHits:
    """Hits of a search, their sort keys in ranges on disk, and how many hits come before each range."""

    hits: DataFrame
    keys: DataFrame
    ends: tuple[int, ...]
    sort: Sort

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0


def rank_hits(
    tx: DataFrame, c: Criteria | None, sort: Sort = DEFAULT_SORT, ranges: int | None = None
) -> RankedHits:
    """Prepare pages by number: any page, however deep, then sorts one range.

    Only the sort keys and ids of the hits are shuffled, into ranges of the whole key; the id breaks ties, so a value
    that many rows share is split too. They are written once, unsorted, a folder for each range. The driver gets a
    count for each of the ``ranges`` (by default as many as shuffle partitions), never keys.
    """
    order = sort_columns(sort)
    spark = tx.sparkSession
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = public_columns(criteria_filter(active(tx), c))
    names = list(dict.fromkeys([*[name for name, _ in sort], "id"]))
    path = new_step_folder(spark)
    keys = hits.select(*names).repartitionByRange(ranges, *order)
    keys.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    schema = keys.withColumn("_range", F.lit(0)).schema
    stored = spark.read.schema(schema).parquet(path)
    counted = dict(stored.groupBy("_range").count().collect())
    ends, seen = [], 0
    for n in range(ranges):
        seen += counted.get(n, 0)
        ends.append(seen)
    return RankedHits(hits, stored, tuple(ends), tuple(sort))


def page_keys(ranked: RankedHits, page: int, size: int) -> DataFrame:
    """Keys and ``_rank`` (from 0) of one page, from the ranges that hold it."""
    first, last = page * size, (page + 1) * size
    starts = (0, *ranked.ends[:-1])
    held = [n for n, (a, b) in enumerate(zip(starts, ranked.ends)) if a < last and b > first and a < b]
    before = F.lit(0)
    for n in held:
        before = F.when(F.col("_range") == n, F.lit(starts[n])).otherwise(before)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*sort_columns(ranked.sort)))
    rows = ranked.keys.where(F.col("_range").isin(held)).withColumn("_rank", before + inside - 1)
    return rows.where((F.col("_rank") >= first) & (F.col("_rank") < last))


def ranked_page(
    ranked: RankedHits, page: int, size: int | None = None, most: int = MAX_PAGE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """What ``search_page`` returns, without keeping the rows before the page. Beyond the end, a page has no rows.

    The ids of the page, at most ``most``, go into the scan as a condition, so row groups without them are left out.
    """
    if page < 0:
        raise ValueError("page must be >= 0")
    size = page_size(size, most)
    ids = [r.id for r in page_keys(ranked, page, size).select("id").collect()]
    rows = ranked.hits.where(F.col("id").isin(ids)).orderBy(*sort_columns(ranked.sort))
    totals = ranked.hits.sparkSession.range(1).select(F.lit(ranked.total).cast("bigint").alias("total_elements"))
    return rows, _metadata_of(totals, page, size)


def search_after(
    tx: DataFrame,
    c: Criteria | None,
    last_date=None,
    last_id: int | None = None,
    size: int | None = None,
    most: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """The rows that follow (last_date, last_id) in the default order.

    Reads no skipped page again, and the date bound prunes row groups, so page 10,000 costs what
    page 1 costs.
    """
    hits = public_columns(criteria_filter(active(tx), c))
    if last_date is not None:
        day = F.lit(last_date)
        hits = hits.where(
            (F.col("date") <= day)
            & ((F.col("date") < day) | (F.col("id") < F.lit(last_id)))
        )
    return hits.orderBy(*sort_columns(DEFAULT_SORT)).limit(page_size(size, most))


def count_matching(tx: DataFrame, c: Criteria | None, owner: str | None = None) -> DataFrame:
    """Number of matching active rows, of one owner or of all."""
    hits = criteria_filter(active(tx), c)
    if owner is not None:
        hits = hits.where(F.col("owner_id") == owner)
    return hits.agg(F.count("*").alias("n"))


def count_by_owner(tx: DataFrame, c: Criteria | None) -> DataFrame:
    """``count_matching`` for every owner in one pass."""
    return criteria_filter(active(tx), c).groupBy("owner_id").agg(F.count("*").alias("n"))


def list_transactions(tx: DataFrame, owner: str) -> DataFrame:
    """All active rows of one owner, unordered."""
    return active(tx).where(F.col("owner_id") == owner)
