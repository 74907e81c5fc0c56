"""Batch changes: each takes a table and a change set and returns the new table and an outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical_amount
from ..session import materialize

BUCKETS_PER_TASK = 16


def assign_ids(
    rows: DataFrame, identity: Sequence[str], start: int | Column = 0, buckets: int | None = None
) -> DataFrame:
    """Rows with a dense, unique ``id`` above ``start``.

    ``identity`` names columns that are unique per row. Rows are numbered inside hash buckets of
    that identity, and a bucket starts where the counts of the buckets before it end; so numbering
    runs on all tasks, has no hot bucket, and a repeated task numbers its rows the same way. Only
    the ``buckets`` counts are summed up in one place: sixteen for each shuffle task, if none is given.
    """
    if buckets is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = BUCKETS_PER_TASK * tasks
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_b").orderBy(*identity)
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        keyed.withColumn("_r", F.row_number().over(within))
        .join(offsets, "_b")
        .withColumn("id", (base + F.col("_o") + F.col("_r")).cast("bigint"))
        .drop("_b", "_r", "_o")
    )


def create_transactions(
    rows: DataFrame, identity: Sequence[str], created_at: datetime, start: int = 0
) -> DataFrame:
    """New transactions from accepted rows: owner kept, ids assigned, category dropped."""
    shaped = rows.drop("category", "allow_duplicate", "outcome", "duplicate", "duplicate_reason")
    return (
        assign_ids(shaped, identity, start)
        .withColumn("amount", canonical_amount(F.col("amount")))
        .withColumn("created_at", F.lit(created_at))
        .withColumn("updated_at", F.lit(None).cast("timestamp"))
        .withColumn("created_by", F.col("owner_id"))
        .withColumn("updated_by", F.lit(None).cast("string"))
        .withColumn("deleted", F.lit(False))
        .withColumn("deleted_at", F.lit(None).cast("timestamp"))
        .withColumn("deleted_by", F.lit(None).cast("string"))
    )


def append_transactions(tx: DataFrame, path: str) -> None:
    """Append accepted rows as one atomic job, partitioned by year and clustered by owner.

    A failed write leaves nothing readable: task output becomes visible at job commit. The rebalance
    hint splits a year or owner that holds much of the batch over several files.
    """
    (
        tx.withColumn("year", F.year("date"))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", "owner_id", "date")
        .write.partitionBy("year")
        .mode("append")
        .parquet(path)
    )


def _may_act(requests_any: Column, owner: Column, actor: Column) -> Column:
    return F.coalesce(requests_any, F.lit(False)) | (owner == actor)


def soft_delete(
    tx: DataFrame, requests: DataFrame, deleted_at: datetime
) -> tuple[DataFrame, DataFrame]:
    """Mark requested transactions deleted.

    ``requests``: request_id, pos, transaction_id, actor, can_act_on_any. Per id, the first request
    (by request_id, pos) that finds the row active and in the actor's reach deletes it; all others
    are NOT_FOUND. Returns (new table, outcome per request).
    """
    order = F.struct("request_id", "pos")
    rows = tx.where(~F.col("deleted")).select(F.col("id").alias("transaction_id"), "owner_id")
    seen = requests.join(rows, "transaction_id", "left").withColumn(
        "_valid",
        F.col("owner_id").isNotNull()
        & _may_act(F.col("can_act_on_any"), F.col("owner_id"), F.col("actor")),
    )
    first = (
        seen.where("_valid")
        .groupBy("transaction_id")
        .agg(F.min(order).alias("_first"), F.min_by("actor", order).alias("_by"))
    )
    outcome = seen.join(first, "transaction_id", "left").select(
        "request_id",
        "pos",
        "transaction_id",
        F.when(F.col("_valid") & (order == F.col("_first")), "DELETED")
        .otherwise("NOT_FOUND")
        .alias("outcome"),
    )
    hits = first.select(F.col("transaction_id").alias("id"), "_by")
    hit = F.col("_by").isNotNull()
    new = tx.join(hits, "id", "left").withColumns(
        {
            "deleted": F.col("deleted") | hit,
            "deleted_by": F.when(hit, F.col("_by")).otherwise(F.col("deleted_by")),
            "deleted_at": F.when(hit, F.lit(deleted_at)).otherwise(F.col("deleted_at")),
        }
    )
    return new.select(*tx.columns), outcome


def delete_summary(outcome: DataFrame) -> DataFrame:
    """Per request: ids deleted and ids not found. The ids are the outcome's rows in pos order."""
    return outcome.groupBy("request_id").agg(
        F.count_if(F.col("outcome") == "DELETED").alias("deleted_count"),
        F.count_if(F.col("outcome") == "NOT_FOUND").alias("not_found_count"),
    )


def apply_patch(tx: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change description and account of active rows in the actor's reach; NULL keeps a value.

    ``patches``: seq, transaction_id, actor, can_act_on_any, description, account_id. Several
    patches of one row apply in seq order, so the last non-NULL value of each field wins.
    """
    p = patches.select(
        "seq",
        F.col("transaction_id").alias("id"),
        "actor",
        "can_act_on_any",
        F.col("description").alias("new_description"),
        F.col("account_id").alias("new_account_id"),
    )
    rows = tx.where(~F.col("deleted")).select("id", "owner_id")
    seen = p.join(rows, "id", "left").withColumn(
        "_valid",
        F.col("owner_id").isNotNull()
        & _may_act(F.col("can_act_on_any"), F.col("owner_id"), F.col("actor")),
    )

    def last(field: str) -> Column:
        value = F.col(field)
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(field)

    folded = (
        seen.where("_valid").groupBy("id").agg(last("new_description"), last("new_account_id"))
    )
    new = tx.join(folded, "id", "left").withColumns(
        {
            "description": F.coalesce("new_description", "description"),
            "account_id": F.coalesce("new_account_id", "account_id"),
        }
    )
    outcome = seen.select(
        "seq",
        F.col("id").alias("transaction_id"),
        F.when(F.col("_valid"), "UPDATED").otherwise("NOT_FOUND").alias("outcome"),
    )
    return new.select(*tx.columns), outcome


def patch_errors(patches: DataFrame) -> DataFrame:
    """Patches whose text is too long: description over 500 or account over 100 characters."""
    return patches.select(
        "seq",
        F.when(F.length("description") > 500, "description")
        .when(F.length("account_id") > 100, "account_id")
        .alias("field"),
    ).where(F.col("field").isNotNull())


def backfill(df: DataFrame, column: str, *sources: Column) -> DataFrame:
    """Fill NULLs of a column from the first non-NULL source."""
    return df.withColumn(column, F.coalesce(F.col(column), *sources))


def update_from(
    target: DataFrame,
    source: DataFrame,
    on: Mapping[str, str],
    assign: Mapping[str, str],
) -> DataFrame:
    """Set target columns from the matching source row; rows without a match keep their values.

    ``on`` maps target to source key columns (the source has one row per key); ``assign`` maps
    target to source value columns.
    """
    picked = source.select(
        *[F.col(s).alias(f"_k_{t}") for t, s in on.items()],
        *[F.col(s).alias(f"_v_{t}") for t, s in assign.items()],
        F.lit(True).alias("_hit"),
    )
    condition = None
    for t in on:
        equal = F.col(t) == F.col(f"_k_{t}")
        condition = equal if condition is None else condition & equal
    joined = target.join(picked, condition, "left")
    values = {
        t: F.when(F.col("_hit"), F.col(f"_v_{t}")).otherwise(F.col(t)) for t in assign
    }
    return joined.withColumns(values).select(*target.columns)


def delete_by_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is none of a short list of values."""
    return df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def remap_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Rename values of a column; others stay."""
    value = F.col(column)
    renamed = value
    for old, new in mapping.items():
        renamed = F.when(value == old, F.lit(new)).otherwise(renamed)
    return df.withColumn(column, renamed)


def prior_imports(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with the earlier import of the same content by the same user, if any.

    ``files``: content_hash, imported_by and whatever else. The ledger has one row per
    (content_hash, imported_by).
    """
    previous = ledger.select(
        "content_hash",
        "imported_by",
        F.col("id").alias("previous_import_id"),
        F.col("original_filename").alias("previous_filename"),
        F.col("imported_at").alias("previous_imported_at"),
        F.col("statement_format_id").alias("previous_format_id"),
        F.col("account_id").alias("previous_account_id"),
        F.col("transaction_count").alias("previous_transaction_count"),
    )
    seen = F.col("previous_import_id").isNotNull()
    return files.join(previous, ["content_hash", "imported_by"], "left").withColumns(
        {
            "already_imported": seen,
            "warning_code": F.when(seen, F.lit("FILE_ALREADY_IMPORTED")),
        }
    )


def record_imports(
    ledger: DataFrame, batches: DataFrame, imported_at: datetime
) -> tuple[DataFrame, DataFrame]:
    """Write batches into the import ledger.

    ``batches``: batch_seq (unique), imported_by, content_hash, original_filename,
    statement_format_id, parser_revision_id, account_id, file_size_bytes, created. A batch that
    created nothing is not recorded. The first batch of an unknown (content, user) makes a ledger
    row; later ones and known ones reuse the row. Returns (new ledger, batch_seq -> file_import_id).
    """
    key = ["content_hash", "imported_by"]
    made = batches.where(F.col("created") > 0)
    fresh = made.join(ledger.select(*key), key, "left_anti")
    detail = [c for c in fresh.columns if c not in key]
    first = fresh.groupBy(*key).agg(
        F.min_by(F.struct(*detail), "batch_seq").alias("_f")
    )
    last_id = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    rows = assign_ids(first, key, last_id).select(
        "id",
        "content_hash",
        F.col("_f.original_filename").alias("original_filename"),
        F.col("_f.statement_format_id").alias("statement_format_id"),
        F.col("_f.parser_revision_id").alias("parser_revision_id"),
        F.col("_f.account_id").alias("account_id"),
        F.col("_f.file_size_bytes").alias("file_size_bytes"),
        F.col("_f.created").cast("int").alias("transaction_count"),
        "imported_by",
        F.lit(imported_at).alias("imported_at"),
    )
    new_ledger = ledger.unionByName(materialize(rows))
    links = made.join(
        new_ledger.select(*key, F.col("id").alias("file_import_id")), key
    ).select("batch_seq", "file_import_id")
    return new_ledger, links
