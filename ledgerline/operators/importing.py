"""Batch import: validate, decide duplicates, record the file, create transactions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .changes import create_transactions, record_imports
from .dedup import accept_batch, batch_outcome
from .quality import batch_status, business_errors, required_field_errors


@dataclass(frozen=True)
class ImportResult:
    created: DataFrame  # new transactions, linked to their file import
    ledger: DataFrame  # the new import ledger
    outcome: DataFrame  # counts and status per batch
    errors: DataFrame  # validation errors, one row each


def import_batch(
    incoming: DataFrame,
    sources: DataFrame,
    tx: DataFrame,
    ledger: DataFrame,
    as_of: date,
    now: datetime,
) -> ImportResult:
    """Import all batches of ``incoming``, each all-or-nothing.

    ``sources`` has one row per batch: owner_id, batch_id, batch_seq, content_hash,
    original_filename, statement_format_id, parser_revision_id, account_id, file_size_bytes. A batch
    with any validation error, or without any accepted row, leaves no trace but its outcome. Both tables
    are written down first: checks, counts and decisions all read them.
    """
    key = ["owner_id", "batch_id"]
    incoming, tx = materialize(incoming), materialize(tx)
    errors = materialize(
        required_field_errors(incoming).unionByName(business_errors(incoming, as_of))
    )
    status = batch_status(incoming, errors)
    valid = status.where("status = 'VALID'").select(*key)
    decided = materialize(accept_batch(incoming.join(valid, key, "left_semi"), tx))
    counts = materialize(batch_outcome(decided))

    batches = sources.join(counts.select(*key, "created"), key).withColumn(
        "imported_by", F.col("owner_id")
    )
    new_ledger, links = record_imports(ledger, batches.drop("owner_id", "batch_id"), now)
    linked = sources.select(*key, "batch_seq").join(links, "batch_seq").drop("batch_seq")
    accepted = decided.where("outcome <> 'SKIP'").join(linked, key)
    last_id = tx.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = create_transactions(accepted, ["owner_id", "batch_id", "row_pos"], now, last_id)

    rejected = status.where("status <> 'VALID'").select(
        *key,
        *[F.lit(0).cast("bigint").alias(c) for c in counts.columns[2:5]],
        "status",
        F.format_string("%d validation errors", "errors").alias("message"),
    )
    return ImportResult(created, new_ledger, counts.unionByName(rejected), errors)
