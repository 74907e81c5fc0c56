"""One query per operator over the supplied tables. Every query reads whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import values as V
from ..operators import changes, dedup, formats, inference, quality, search, stored_changes, views
from ..operators.criteria import Criteria, active, criteria_filter, id_set, scope_to_actor
from ..operators.importing import import_batch
from ..session import materialize, new_step_folder
from ..sources import chunks as C
from ..sources import csv_splits, csv_statements, files, line_layouts, preview, revisions, text_tables, two_column
from . import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, decimals as doubles, text arrays joined by ``|``."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# -- criteria search ---------------------------------------------------------------------------


@query
def id_equals(spark, sf_dir):
    hits = criteria_filter(active(S.transactions(spark, sf_dir)), Criteria(id=700))
    return search.public_columns(hits)


@query
def criteria_search(spark, sf_dir):
    c = Criteria(
        bank_names=("nation_1", " "),
        date_from=dt.date(1996, 1, 1),
        date_to=dt.date(2000, 12, 31),
        min_amount=Decimal("50000.00"),
        max_amount=Decimal("400000.00"),
        type="CREDIT",
        description="building household",
        search_text="urgent low",
    )
    return search.public_columns(criteria_filter(active(S.transactions(spark, sf_dir)), c))


@query
def search_page(spark, sf_dir):
    c = Criteria.from_filter(bank_name="nation_2")
    rows, _ = search.search_page(S.transactions(spark, sf_dir), c, page=2, size=40)
    return rows


@query
def search_page_meta(spark, sf_dir):
    c = Criteria.from_filter(bank_name="nation_2")
    return search.search_page(S.transactions(spark, sf_dir), c, page=2, size=40)[1]


def _middle_page(spark, sf_dir):
    sort = [("description", "asc"), ("updated_at", "desc")]
    ranked = search.rank_hits(S.transactions(spark, sf_dir), Criteria(type="DEBIT"), sort)
    return search.ranked_page(ranked, ranked.total // 80, 40)


@query
def deep_page(spark, sf_dir):
    """The page in the middle of all debits by description, of which many share one."""
    return _middle_page(spark, sf_dir)[0].select("id", "description", "updated_at")


@query
def deep_page_meta(spark, sf_dir):
    return _middle_page(spark, sf_dir)[1]


@query
def search_after(spark, sf_dir):
    return search.search_after(
        S.transactions(spark, sf_dir), None, dt.date(1999, 6, 1), 5000, size=100
    ).select("id", "date")


@query
def null_order_sort(spark, sf_dir):
    rows, _ = search.search_page(
        S.transactions(spark, sf_dir), None, 0, 100, [("updated_at", "desc")]
    )
    return rows.select("id", "owner_id", "updated_at")


@query
def account_order_sort(spark, sf_dir):
    rows, _ = search.search_page(
        S.transactions(spark, sf_dir), None, 0, 100, [("account_id", "asc"), ("amount", "desc")]
    )
    return rows.select("id", "account_id", "amount")


@query
def count_by_owner(spark, sf_dir):
    c = Criteria(min_amount=Decimal("1000.00"), date_to=dt.date(2000, 1, 1))
    return search.count_by_owner(S.transactions(spark, sf_dir), c)


@query
def count_matching(spark, sf_dir):
    c = Criteria(search_text="automobile", type="DEBIT")
    return search.count_matching(S.transactions(spark, sf_dir), c, owner="usr_3")


@query
def text_words_or(spark, sf_dir):
    c = Criteria(description=" Automobile\tURGENT ", search_text="ref 77")
    return criteria_filter(active(S.transactions(spark, sf_dir)), c).select("id", "description")


@query
def wildcard_literal(spark, sf_dir):
    tx = active(S.transactions(spark, sf_dir))
    wanted = ["nation_1", "nation%1", "n_tion", "%", "_", "NATION\\"]
    parts = [
        criteria_filter(tx, Criteria(bank_names=(w,))).select(F.lit(w).alias("word"), "id")
        for w in wanted
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("word").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def account_bank_sets(spark, sf_dir):
    c = Criteria(account_ids=("acct-12 acct-9", "ACCT-101"), bank_names=("nation_2", "3 4", ""))
    return criteria_filter(active(S.transactions(spark, sf_dir)), c).select(
        "id", "account_id", "bank_name"
    )


@query
def currency_in(spark, sf_dir):
    c = Criteria(currency_iso_codes=("usd", "Thb", " "))
    return (
        criteria_filter(active(S.transactions(spark, sf_dir)), c)
        .groupBy("currency_iso_code")
        .agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    )


@query
def timestamp_ranges(spark, sf_dir):
    c = Criteria(
        created_after=dt.datetime(1997, 1, 1),
        created_before=dt.datetime(1999, 12, 31),
        updated_after=dt.datetime(1998, 1, 1),
        updated_before=dt.datetime(1999, 6, 30),
    )
    return criteria_filter(active(S.transactions(spark, sf_dir)), c).select(
        "id", "created_at", "updated_at"
    )


@query
def owner_list(spark, sf_dir):
    return search.list_transactions(S.transactions(spark, sf_dir), "usr_7").select(
        "id", "owner_id", "amount"
    )


@query
def actor_scope(spark, sf_dir):
    tx = active(S.transactions(spark, sf_dir))
    own = scope_to_actor(tx, "usr_4").select(F.lit("own").alias("scope"), "id", "amount")
    every = scope_to_actor(tx, "usr_4", True).select(F.lit("any").alias("scope"), "id", "amount")
    return own.unionByName(every).groupBy("scope").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids")
    )


# -- text functions ----------------------------------------------------------------------------


@query
def normalize_description(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.normalize_description(F.col("text"))).alias("digest"))


@query
def numeric_tokens(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    tokens = X.numeric_tokens(F.col("text"))
    return docs.select(
        "doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest")
    )


def _pairs(spark, sf_dir):
    tx = S.transactions(spark, sf_dir).select("id", F.col("description").alias("stored"))
    inc = S.incoming(spark, sf_dir).selectExpr("row_pos div 4 AS id", "row_pos", "description")
    return inc.join(tx, "id")


@query
def similarity(spark, sf_dir):
    norm = _pairs(spark, sf_dir).select(
        "row_pos",
        X.normalize_description(F.col("description")).alias("a"),
        X.normalize_description(F.col("stored")).alias("b"),
    )
    return norm.select(
        "row_pos",
        F.levenshtein("a", "b").alias("distance"),
        F.round(X.similarity(F.col("a"), F.col("b")), 9).alias("similarity"),
    )


@query
def descriptions_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "row_pos", X.descriptions_match(F.col("description"), F.col("stored")).alias("matched")
    )


@query
def statement_amounts(spark, sf_dir):
    """Amount texts rendered in several ways and read back."""
    orders = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "format_number(round(o_totalprice, 2), 2) AS m", "o_orderkey % 5 AS v"
    )
    text = F.expr(
        "CASE v WHEN 0 THEN concat('(', m, ')') WHEN 1 THEN concat('-$', m) "
        "WHEN 2 THEN concat('$ ', m, '-') WHEN 3 THEN concat('+', m) ELSE concat(m, '.') END"
    )
    told = orders.select("id", text.alias("t"))
    return told.select(
        "id",
        V.csv_amount(F.col("t")).cast("decimal(38,2)").alias("csv_amount"),
        V.signed_amount(F.col("t")).cast("decimal(38,2)").alias("signed_amount"),
    )


@query
def canonical_amounts(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem")
    exact = (
        F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    )
    return lines.groupBy("l_returnflag").agg(
        F.sum(V.canonical_amount(exact)).cast("decimal(38,2)").alias("rounded")
    )


@query
def statement_dates(spark, sf_dir):
    """Date texts in several patterns, impossible days 29 to 31 included, read back."""
    orders = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "year(o_orderdate) AS y", "month(o_orderdate) AS m",
        "29 + o_orderkey % 4 AS d", "o_orderkey % 4 AS v",
    )
    told = orders.selectExpr(
        "id",
        """CASE v WHEN 0 THEN format_string('%02d/%02d/%02d', m, d, y % 100)
             WHEN 1 THEN format_string('%d/%d/%d', d, m, y)
             WHEN 2 THEN format_string('%d-%02d-%02d', y, m, d)
             ELSE format_string('%d/%d/%d 23:59', m, d, y) END AS t""",
        """CASE v WHEN 0 THEN 'MM/dd/uu' WHEN 1 THEN 'd/M/uuuu' WHEN 2 THEN 'uuuu-MM-dd'
             ELSE 'M/d/yyyy HH:mm' END AS p""",
    )
    return told.select("id", V.statement_date(F.col("t"), F.col("p")).alias("date"))


# -- duplicates and import ---------------------------------------------------------------------


@query
def duplicate_candidates(spark, sf_dir):
    return dedup.duplicate_candidates(S.incoming(spark, sf_dir), S.transactions(spark, sf_dir))


@query
def candidate_groups(spark, sf_dir):
    return dedup.candidate_counts(S.incoming(spark, sf_dir), S.transactions(spark, sf_dir))


@query
def preview_marking(spark, sf_dir):
    marked = dedup.mark_duplicates(S.incoming(spark, sf_dir), S.transactions(spark, sf_dir))
    return marked.select("owner_id", "row_pos", "duplicate", "duplicate_reason")


HOT_TEXT = """concat('CARD PAYMENT SIAM MALL ', p_name, ' ', translate(lpad(cast(p_partkey % {step} AS string), 3, '0'),
    '0123456789', 'ABCDEFGHIJ'), ' ', p_type)"""


@query
def hot_key_marking(spark, sf_dir):
    """All parts as rows of one batch and one key: long boilerplate, no digits, names that differ by letters."""
    parts = S.table(spark, sf_dir, "part")
    key = [
        "'usr_0' AS owner_id", "'Siam Bank' AS bank_name", "date'2024-01-01' AS date",
        "cast(10 AS decimal(38,2)) AS amount", "'DEBIT' AS type", "'THB' AS currency_iso_code",
    ]
    incoming = parts.selectExpr(
        *key, "'b' AS batch_id", "p_partkey AS row_pos", f"{HOT_TEXT.format(step=997)} AS description",
        "false AS allow_duplicate",
    )
    stored = parts.where("p_size = 7").selectExpr(
        *key, "p_partkey AS id", f"{HOT_TEXT.format(step=89)} AS description", "false AS deleted"
    )
    marked = dedup.mark_duplicates(incoming, stored)
    return marked.select("row_pos", "duplicate_reason")


@query
def batch_accept(spark, sf_dir):
    return dedup.accept_batch(S.incoming(spark, sf_dir), S.transactions(spark, sf_dir)).select(
        "owner_id", "row_pos", "outcome"
    )


@query
def batch_outcome(spark, sf_dir):
    return dedup.batch_outcome(
        dedup.accept_batch(S.incoming(spark, sf_dir), S.transactions(spark, sf_dir))
    ).drop("message")


def _shifted(spark, sf_dir):
    """Incoming rows and transactions ten years on, so that some batches are valid."""
    later = F.date_add("date", F.when(F.col("owner_id") < "usr_15", 3653).otherwise(0))
    return (
        S.incoming(spark, sf_dir).withColumn("date", later),
        S.transactions(spark, sf_dir).withColumn("date", later),
    )


@query
def batch_import(spark, sf_dir):
    """The whole import: created rows per batch with the file they came from."""
    rows, tx = _shifted(spark, sf_dir)
    done = import_batch(
        rows, S.batch_sources(spark, sf_dir), tx, S.import_ledger(spark, sf_dir), S.LATER, S.NOW
    )
    made = done.created.groupBy("owner_id", "batch_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.sum("amount").cast("decimal(38,2)").alias("total"),
        F.count_distinct("file_import_id").alias("files"),
    )
    zero = F.lit(0)
    return done.outcome.join(made, ["owner_id", "batch_id"], "left").select(
        "owner_id", "created", "duplicates_skipped", "duplicates_imported", "status",
        *[F.coalesce(c, zero.cast("double" if c == "total" else "bigint")).alias(c)
          for c in ("rows", "ids", "total", "files")],
    )


@query
def assigned_ids(spark, sf_dir):
    """Dense ids for all incoming rows."""
    rows = changes.assign_ids(S.incoming(spark, sf_dir), ["owner_id", "batch_id", "row_pos"], 1000)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )


@query
def import_ledger(spark, sf_dir):
    new, links = changes.record_imports(
        S.import_ledger(spark, sf_dir), S.uploads(spark, sf_dir), S.NOW
    )
    linked = links.join(
        new.select(F.col("id").alias("file_import_id"), "original_filename", "imported_by",
                   "transaction_count"),
        "file_import_id",
    )
    return linked.drop("file_import_id")


@query
def prior_imports(spark, sf_dir):
    return changes.prior_imports(
        S.uploads(spark, sf_dir), S.import_ledger(spark, sf_dir)
    ).select(
        "upload_id", "already_imported", "warning_code", "previous_filename",
        "previous_account_id", "previous_imported_at",
    )


@query
def content_fingerprints(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("content")
    )
    return files.with_content_hash(docs).select("doc_id", "content_hash")


@query
def file_checks(spark, sf_dir):
    """Upload checks over pages taken as files."""
    pages = S.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "if(page_id % 9 = 0, ' \\t ', concat(' ', url, ' ')) AS filename",
        "if(page_id % 10 = 0, 0, cast(octet_length(html) AS bigint)) AS length",
    )
    return files.check_files(pages)


# -- views -------------------------------------------------------------------------------------


@query
def view_membership(spark, sf_dir):
    return views.view_membership(
        S.saved_views(spark, sf_dir), S.transactions(spark, sf_dir), S.VIEW_AS_OF
    )


@query
def view_counts(spark, sf_dir):
    return views.view_counts(
        S.saved_views(spark, sf_dir), S.transactions(spark, sf_dir), S.VIEW_AS_OF
    )


@query
def pin_fold(spark, sf_dir):
    edits, _ = views.fold_view_events(
        S.saved_views(spark, sf_dir), S.view_events(spark, sf_dir), S.transactions(spark, sf_dir)
    )
    return edits


@query
def view_bulk_update(spark, sf_dir):
    _, outcome = views.fold_view_events(
        S.saved_views(spark, sf_dir), S.view_events(spark, sf_dir), S.transactions(spark, sf_dir)
    )
    return views.bulk_view_summary(outcome)


@query
def stored_id_sets(spark, sf_dir):
    """Pinned ids of every view, read from JSON, edited and written back."""
    from ..operators.criteria import id_set_add, id_set_remove, id_set_text

    v = S.saved_views(spark, sf_dir)
    pinned, excluded = id_set(F.col("pinned_ids")), id_set(F.col("excluded_ids"))
    return v.select(
        "id",
        id_set_text(id_set_remove(pinned, excluded)).alias("only_pinned"),
        F.size(id_set_add(pinned, excluded)).alias("either"),
    )


@query
def view_list(spark, sf_dir):
    return views.list_views(S.saved_views(spark, sf_dir), "usr_3").select("id", "name")


@query
def stored_view_edits(spark, sf_dir):
    """Views with their id sets as stored text after all events."""
    saved, tx = S.saved_views(spark, sf_dir), S.transactions(spark, sf_dir)
    edits, _ = views.fold_view_events(saved, S.view_events(spark, sf_dir), tx)
    return views.store_view_edits(saved, edits).select("id", "pinned_ids", "excluded_ids")


# -- change sets -------------------------------------------------------------------------------


@query
def id_resolution(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id * 3 div 2 AS transaction_id",
        "concat('usr_', user_id % 20) AS owner_id",
    )
    return views.resolve_ids(events, S.transactions(spark, sf_dir), "owner_id", "transaction_id")


@query
def bulk_delete(spark, sf_dir):
    new, _ = changes.soft_delete(
        S.transactions(spark, sf_dir), S.delete_requests(spark, sf_dir), S.NOW
    )
    return new.select("id", "deleted", "deleted_by")


@query
def bulk_delete_outcome(spark, sf_dir):
    _, outcome = changes.soft_delete(
        S.transactions(spark, sf_dir), S.delete_requests(spark, sf_dir), S.NOW
    )
    return changes.delete_summary(outcome)


@query
def patch_apply(spark, sf_dir):
    new, _ = changes.apply_patch(S.transactions(spark, sf_dir), S.patches(spark, sf_dir))
    return new.select("id", "description", "account_id")


@query
def patch_outcome(spark, sf_dir):
    _, outcome = changes.apply_patch(S.transactions(spark, sf_dir), S.patches(spark, sf_dir))
    return outcome


@query
def not_found_ids(spark, sf_dir):
    """Ids that a delete request did not find, numbered in request order, repeats kept."""
    _, outcome = changes.soft_delete(
        S.transactions(spark, sf_dir), S.delete_requests(spark, sf_dir), S.NOW
    )
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))
    lost = outcome.where("outcome = 'NOT_FOUND'")
    return lost.select("request_id", place.alias("place"), "transaction_id")


@query
def patch_errors(spark, sf_dir):
    """Documents taken as descriptions, their sources repeated as account ids."""
    patches = S.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS seq", "text AS description",
        "repeat(source, cast(1 + doc_id % 40 AS int)) AS account_id",
    )
    return changes.patch_errors(patches)


@query
def transaction_sink(spark, sf_dir):
    """Every transaction written by year, then read back."""
    path = new_step_folder(spark)
    changes.append_transactions(S.transactions(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "year", "owner_id", "amount", "description")


def _stored_year(spark, sf_dir, asked, change):
    """Transactions written by year, then changed where the requests ask for some of 1997, then read back.

    ``file_kept`` is null in 1997; elsewhere it tells whether the row is still in the file it was written to.
    """
    path = new_step_folder(spark)
    tx = S.transactions(spark, sf_dir)
    changes.append_transactions(tx, path)
    written = spark.createDataFrame([(name,) for name in stored_changes.stored_files(spark, path)], "file string")
    ids = tx.where("year(date) = 1997").select(F.col("id").alias("transaction_id"))
    change(spark, path, asked.join(ids, "transaction_id", "left_semi"))
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    kept = rows.join(written.withColumn("old", F.lit(True)), "file", "left")
    return kept.withColumn("file_kept", F.when(F.col("year") != 1997, F.coalesce("old", F.lit(False))))


@query
def stored_bulk_delete(spark, sf_dir):
    asked = S.delete_requests(spark, sf_dir)
    new = _stored_year(
        spark, sf_dir, asked, lambda *where: stored_changes.soft_delete_stored(*where, S.NOW)
    )
    return new.select("id", "deleted", "deleted_by", "file_kept")


@query
def stored_patch_apply(spark, sf_dir):
    new = _stored_year(spark, sf_dir, S.patches(spark, sf_dir), stored_changes.apply_patch_stored)
    return new.select("id", "description", "account_id", "file_kept")


@query
def imported_files(spark, sf_dir):
    """One small file for each supplier, read back with its earlier import, if any."""
    path = S.supplier_files(spark, sf_dir)
    found = files.read_statement_files(spark, path).where("filename like 'part-%'").withColumns(
        {
            "supplier": F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("bigint"),
            "imported_by": F.lit("usr_1"),
        }
    )
    ledger = S.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr(
        "sha2(concat(s_name, '\n'), 256) AS content_hash",
        "if(s_suppkey % 2 = 0, 'usr_1', 'usr_2') AS imported_by", "s_suppkey + 500 AS id",
        "concat(s_name, '.csv') AS original_filename", "current_timestamp() AS imported_at",
        "1 AS statement_format_id", "'a' AS account_id", "7 AS transaction_count",
    )
    return files.with_import_status(found, ledger).select(
        "supplier", "length", "error", "already_imported", "previous_import_id", "previous_filename",
        "warning_code",
    )


@query
def backfill_owner(spark, sf_dir):
    old = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "if(o_orderkey % 3 = 0, concat('usr_', o_custkey), NULL) AS owner_id",
        "if(o_orderkey % 2 = 0, concat('made_', o_custkey), NULL) AS created_by",
    )
    return changes.backfill(old, "owner_id", F.col("created_by"), F.lit("migration")).select(
        "id", "owner_id"
    )


@query
def update_from(spark, sf_dir):
    """Imports get the format that their legacy key names."""
    imports = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('Supplier#', lpad(cast(o_custkey % 200 AS string), 9, '0')) AS format",
        "cast(-1 AS bigint) AS statement_format_id",
    )
    suppliers = S.table(spark, sf_dir, "supplier")
    return changes.update_from(
        imports, suppliers, {"format": "s_name"}, {"statement_format_id": "s_suppkey"}
    )


@query
def config_json(spark, sf_dir):
    return formats.initial_revisions(S.statement_formats(spark, sf_dir))


@query
def format_key_cleanup(spark, sf_dir):
    f = S.statement_formats(spark, sf_dir).select("id", "format_key")
    kept = changes.delete_by_values(f, "format_key", ["key-1", "key-5"])
    return changes.remap_values(kept, "format_key", {"key-2": "key-two", "key-3": "key-three"})


@query
def format_visibility(spark, sf_dir):
    return formats.visible_formats(
        S.statement_formats(spark, sf_dir), S.users(spark, sf_dir)
    ).select("user_id", "id", "scope")


@query
def format_list(spark, sf_dir):
    return formats.formats_for(S.statement_formats(spark, sf_dir), "usr_3").select(
        "id", "display_name"
    )


@query
def format_selection(spark, sf_dir):
    asked = S.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('usr_', user_id % 20) AS user_id",
        "event_id div 90 AS statement_format_id",
    )
    return formats.resolve_formats(asked, S.statement_formats(spark, sf_dir))


@query
def format_patch(spark, sf_dir):
    p = S.table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "event_id div 90 AS statement_format_id",
        "concat('usr_', user_id % 20) AS user_id", "event_type = 'error' AS can_write_any",
        "CASE WHEN event_id % 4 = 0 THEN concat('Name ', event_id) WHEN event_id % 31 = 0 THEN ' ' END"
        " AS display_name",
        "cast(NULL AS string) AS bank_name",
        "CASE event_id % 5 WHEN 0 THEN 'eur' WHEN 1 THEN 'xxy' END AS default_currency_iso_code",
        "CASE WHEN event_id % 7 = 0 THEN false END AS enabled",
    )
    f = S.statement_formats(spark, sf_dir).select(
        "id", "scope", "owner_id", "display_name", "bank_name", "default_currency_iso_code", "enabled"
    )
    new, _ = formats.patch_formats(f, p)
    return new


@query
def format_create(spark, sf_dir):
    cmds = S.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS seq", "concat('usr_', c_custkey % 20) AS user_id",
        "c_custkey % 2 = 0 AS can_write_any",
        "CASE c_custkey % 3 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'USER' END AS scope",
        "CASE WHEN c_custkey % 13 = 0 THEN 'PDF' ELSE 'CSV' END AS format_type",
        "if(c_custkey % 17 = 0, ' ', c_name) AS display_name", "c_mktsegment AS bank_name",
        "if(c_custkey % 19 = 0, 'zzz', 'thb') AS default_currency_iso_code",
        "'Date' AS date_header", "'dd/MM/uu' AS date_format", "'Memo' AS description_header",
        "'In' AS credit_header", "'Out' AS debit_header",
        "cast(NULL AS string) AS type_header", "cast(NULL AS string) AS category_header",
    )
    f = S.statement_formats(spark, sf_dir).select(
        "id", "format_type", "bank_name", "default_currency_iso_code", "display_name", "scope",
        "owner_id", "enabled",
    )
    revs = formats.initial_revisions(S.statement_formats(spark, sf_dir)).withColumn(
        "id", F.col("statement_format_id")
    )
    new, new_revs, _ = formats.create_formats(f, revs, cmds)
    joined = new.join(
        new_revs.select(F.col("statement_format_id").alias("id"), "parser_type"), "id"
    )
    return joined.groupBy("scope", "format_type", "default_currency_iso_code", "parser_type").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids")
    )


@query
def format_create_errors(spark, sf_dir):
    cmds = S.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS seq", "c_custkey % 2 = 0 AS can_write_any",
        "CASE c_custkey % 3 WHEN 0 THEN 'SYSTEM' END AS scope",
        "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PDF' ELSE 'CSV' END AS format_type",
        "if(c_custkey % 17 = 0, ' ', c_name) AS display_name", "c_mktsegment AS bank_name",
        "if(c_custkey % 19 = 0, 'zzz', 'thb') AS default_currency_iso_code",
        "if(c_custkey % 7 = 0, '', 'Date') AS date_header", "'dd/MM/uu' AS date_format",
        "'Memo' AS description_header", "'In' AS credit_header",
        "cast(NULL AS string) AS debit_header",
    )
    return formats.create_errors(cmds).select("seq", "field", "message")


# -- checks ------------------------------------------------------------------------------------


@query
def validation_errors(spark, sf_dir):
    return quality.business_errors(S.incoming(spark, sf_dir), S.AS_OF).select(
        "owner_id", "row_pos", "field", "message", "value"
    )


@query
def batch_validation(spark, sf_dir):
    rows, _ = _shifted(spark, sf_dir)
    return quality.batch_status(rows, quality.business_errors(rows, S.LATER))


@query
def required_fields(spark, sf_dir):
    rows = S.incoming(spark, sf_dir).selectExpr(
        "owner_id", "batch_id", "row_pos", "if(row_pos % 7 = 0, NULL, date) AS date",
        "if(row_pos % 5 = 0, ' \\t', description) AS description",
        "if(row_pos % 11 = 0, NULL, amount) AS amount", "if(row_pos % 13 = 0, NULL, type) AS type",
        "if(row_pos % 3 = 0, '', bank_name) AS bank_name", "currency_iso_code",
    )
    return quality.required_field_errors(rows).select("owner_id", "row_pos", "field", "message")


@query
def config_audit(spark, sf_dir):
    """Text-table configurations with many kinds of fault."""
    from ..schemas import TABLE_CONFIG_JSON

    stored = S.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        """to_json(named_struct(
             'fileType', if(c_custkey % 23 = 0, 'SCANNED', 'TEXT_PDF'),
             'headerMustContain', CASE c_custkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('Date', ' ')
               ELSE array('Date') END,
             'minimumRows', cast(c_custkey % 3 AS int),
             'dateHeader', if(c_custkey % 5 = 0, ' ', 'Date'),
             'dateFormat', CASE c_custkey % 6 WHEN 0 THEN 'yyyy' WHEN 1 THEN '' ELSE 'MMM d' END,
             'descriptionHeader', 'Memo',
             'amountHeader', if(c_custkey % 2 = 0, 'Amount', NULL),
             'debitHeader', if(c_custkey % 7 = 0, 'Debit', NULL),
             'creditHeader', if(c_custkey % 8 < 3, 'Credit', NULL),
             'typeHeader', if(c_custkey % 9 = 0, 'Type', NULL),
             'negativeMeans', if(c_custkey % 10 = 0, 'CREDIT', NULL),
             'yearSource', if(c_custkey % 11 = 0, NULL, 'EXPLICIT_DATE'))) AS parser_config""",
    )
    configs = stored.select("id", F.from_json("parser_config", TABLE_CONFIG_JSON).alias("c"))
    return quality.table_config_errors(configs.select("id", "c.*"), "id").select(
        "id", "field", "message"
    )


@query
def currency_codes(spark, sf_dir):
    """Every code of three letters: order keys give the first two, each with all last letters."""
    letter = lambda place: f"char(97 + o_orderkey div {place} % 26)"
    starts = S.table(spark, sf_dir, "orders").selectExpr(f"concat({letter(26)}, {letter(1)}) AS start")
    codes = starts.selectExpr("start", "explode(sequence(0, 25)) AS n").selectExpr("concat(start, char(97 + n)) AS code")
    used = codes.groupBy("code").agg(F.count("*").alias("orders"))
    return used.select("code", "orders", quality.known_currency(F.col("code")).alias("known"))


# -- statements --------------------------------------------------------------------------------


@query
def revision_selection(spark, sf_dir):
    return revisions.select_revision(S.parser_attempts(spark, sf_dir)).select(
        "file_id", F.coalesce("parser_revision_id", F.lit(-1)).alias("parser_revision_id"),
        "status", "diagnostic", "row_count", "matched_count", "attempt_count",
    )


@query
def csv_statement_roundtrip(spark, sf_dir):
    catalogue = S.csv_catalogue(spark)
    rows, attempts = csv_statements.parse_csv_statements(
        materialize(S.csv_files(spark, sf_dir, 3653)), *catalogue, S.LATER
    )
    chosen = revisions.selected_rows(rows, attempts)
    return chosen.withColumn("amount", F.col("amount").cast("decimal(38,2)")).drop("parser_revision_id")


def _large_lines(spark, path: str) -> DataFrame:
    layout = F.regexp_extract("path", r"/layout=(\d+)/", 1)
    return csv_splits.read_csv_lines(spark, path, F.concat(F.lit("big-"), layout))


@query
def csv_large_files(spark, sf_dir):
    """All orders in three files, read by splits: rows of files larger than a task."""
    path, uploads = S.large_csv_files(spark, sf_dir, 3653)
    rows, attempts = csv_splits.parse_csv_splits(
        _large_lines(spark, path), uploads, *S.csv_catalogue(spark), S.LATER
    )
    chosen = revisions.selected_rows(rows, attempts)
    return chosen.withColumn("amount", F.col("amount").cast("decimal(38,2)")).drop("parser_revision_id")


@query
def file_preview(spark, sf_dir):
    """Statements of every kind (CSV, card, bank, yearly, two columns, text tables) of all users previewed in one
    job, against stored transactions. Files are known by a hash of what is in them."""
    sheets = S.csv_files(spark, sf_dir, 3653).withColumn("content_hash", F.sha2("content", 256))
    lines = S.card_monthly_lines(spark, sf_dir).unionByName(S.bank_monthly_lines(spark, sf_dir))
    lines = materialize(lines.unionByName(S.card_yearly_lines(spark, sf_dir)))
    chunks = materialize(S.two_column_chunks(spark, sf_dir).unionByName(S.table_chunks(spark, sf_dir)))
    kind, number = F.substring_index("file_id", "-", 1), F.regexp_extract("file_id", "([0-9]+)", 1).cast("bigint")
    said = lines.select("file_id", F.struct("page", F.col("line_no").cast("double").alias("at"), F.lit(0.0).alias("x"), "text").alias("t"))
    said = said.unionByName(chunks.select("file_id", F.struct("page", F.col("y").cast("double").alias("at"), F.col("start_x").cast("double").alias("x"), "text").alias("t")))
    texts = said.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("t"))["text"], "\n").alias("t"))
    others = texts.select(
        "file_id", F.concat("file_id", F.lit(".pdf")).alias("filename"), F.lit(None).cast("binary").alias("content"),
        F.when(kind.isin("card", "bank"), 4).when(kind == "year", 5).when(kind == "two", 6).otherwise(7).cast("bigint").alias("statement_format_id"),
        F.concat(F.lit("acct-"), number).alias("account_id"),
        F.sha2(F.col("t").cast("binary"), 256).alias("content_hash"),
    )
    uploads = sheets.unionByName(others).withColumn("user_id", F.concat(F.lit("usr_"), (number % 2 + 1).cast("string")))
    stored = S.table(spark, sf_dir, "orders").where("o_orderkey div 50 % 3 = 0 and o_orderkey % 5 = 0").selectExpr(
        "o_orderkey AS id", "concat('usr_', o_orderkey div 50 % 2 + 1) AS owner_id", "'Siam Bank' AS bank_name",
        "date_add(cast(o_orderdate AS date), 3653) AS date", "'THB' AS currency_iso_code",
        "cast(round(o_totalprice, 2) AS decimal(38,2)) AS amount",
        "if(o_orderstatus = 'F', 'DEBIT', 'CREDIT') AS type",
        "concat('ORDER-', o_orderkey, ' ', o_orderpriority) AS description", "false AS deleted",
    )
    earlier = sheets.withColumn("n", number).where("n % 3 = 0")
    ledger = earlier.selectExpr(
        "content_hash", "concat('usr_', n % 2 + 1) AS imported_by", "n AS id", "'old.csv' AS original_filename",
        "current_timestamp() AS imported_at", "1 AS statement_format_id", "'a' AS account_id",
        "7 AS transaction_count",
    )
    found = preview.preview_files(
        uploads, lines, chunks, *S.preview_catalogue(spark), stored, ledger, S.LATER
    )
    counted = found.rows.groupBy("file_id").agg(
        F.count("*").alias("rows"), F.count_if("duplicate").alias("duplicates"),
        F.sum("amount").cast("decimal(38,2)").alias("total"),
    )
    zero = F.lit(0).cast("bigint")
    return found.files.join(counted, "file_id", "left").select(
        "file_id", "status", F.coalesce("parser_revision_id", F.lit(-1)).alias("parser_revision_id"),
        F.coalesce("attempt_count", zero).alias("attempts"), F.coalesce("rows", zero).alias("rows"),
        F.coalesce("duplicates", zero).alias("duplicates"), "total", "already_imported",
    )


@query
def csv_file_status(spark, sf_dir):
    catalogue = S.csv_catalogue(spark)
    _, attempts = csv_statements.parse_csv_statements(
        materialize(S.csv_files(spark, sf_dir, 0)), *catalogue, S.AS_OF
    )
    return attempts.drop("priority")


@query
def csv_header_match(spark, sf_dir):
    """Header tests of every rendered file against each layout's required headers."""
    f = S.csv_files(spark, sf_dir, 0).select(
        "file_id", "filename", csv_statements.csv_text(F.col("content")).alias("t")
    )
    match = lambda *names: csv_statements.csv_header_match(
        F.col("filename"), F.col("t"), *[F.lit(n) for n in names]
    )
    return f.select(
        "file_id",
        match("DATE", "particulars", "Deposit").alias("columns"),
        match("transaction date", "Transaction Description", "Transaction Amount").alias("typed"),
        match("Posted", "Memo", "Balance").alias("absent"),
    )


def _layout_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount", F.col("amount").cast("decimal(38,2)")).drop("page", "line_no")


@query
def card_monthly_roundtrip(spark, sf_dir):
    rows, _ = line_layouts.parse_line_layout(
        materialize(S.card_monthly_lines(spark, sf_dir)), line_layouts.CARD_MONTHLY
    )
    return _layout_rows(rows).drop("category", "account_id")


@query
def card_split_roundtrip(spark, sf_dir):
    rows, _ = line_layouts.parse_line_layout(
        materialize(S.card_split_lines(spark, sf_dir)), line_layouts.CARD_MONTHLY
    )
    return _layout_rows(rows).drop("category", "account_id")


@query
def bank_monthly_roundtrip(spark, sf_dir):
    rows, _ = line_layouts.parse_line_layout(
        materialize(S.bank_monthly_lines(spark, sf_dir)), line_layouts.BANK_MONTHLY
    )
    return _layout_rows(rows)


@query
def card_yearly_roundtrip(spark, sf_dir):
    rows, _ = line_layouts.parse_line_layout(
        materialize(S.card_yearly_lines(spark, sf_dir)), line_layouts.CARD_YEARLY
    )
    return _layout_rows(rows).drop("account_id")


@query
def layout_attempts(spark, sf_dir):
    """Every line layout tried on every rendered line statement."""
    lines = materialize(
        S.card_monthly_lines(spark, sf_dir)
        .unionByName(S.bank_monthly_lines(spark, sf_dir))
        .unionByName(S.card_yearly_lines(spark, sf_dir))
    )
    out = None
    for key in (line_layouts.CARD_MONTHLY, line_layouts.BANK_MONTHLY, line_layouts.CARD_YEARLY):
        _, attempts = line_layouts.parse_line_layout(lines, key)
        out = attempts if out is None else out.unionByName(attempts)
    return out


@query
def two_column_roundtrip(spark, sf_dir):
    chunks = materialize(S.two_column_chunks(spark, sf_dir))
    rows, _ = two_column.parse_two_column(chunks, S.chunk_files(chunks))
    return _layout_rows(rows).drop("category")


@query
def two_column_text_roundtrip(spark, sf_dir):
    chunks = materialize(S.two_column_text_chunks(spark, sf_dir))
    rows, _ = two_column.parse_two_column(chunks, S.chunk_files(chunks))
    return _layout_rows(rows).drop("category")


@query
def text_table_roundtrip(spark, sf_dir):
    files = S.chunk_files(S.table_file_ids(spark, sf_dir), 2)
    rows, attempts = text_tables.parse_text_tables(
        S.table_chunks(spark, sf_dir), files, *S.table_catalogue(spark)
    )
    return (
        revisions.selected_rows(rows, attempts)
        .withColumn("amount", F.col("amount").cast("decimal(38,2)"))
        .drop("page", "start_line", "row_pos", "category")
    )


@query
def line_grouping(spark, sf_dir):
    """Lines and cells per file of the rendered two-column statements."""
    lines = C.lines_to_cells(C.chunks_to_lines(materialize(S.two_column_chunks(spark, sf_dir))))
    return lines.groupBy("file_id", "page").agg(
        F.count("*").alias("lines"), F.sum(F.size("cells")).alias("cells")
    )


@query
def table_detection(spark, sf_dir):
    lines = C.lines_to_cells(C.chunks_to_lines(materialize(S.table_chunks(spark, sf_dir))))
    return C.detect_tables(lines).select(
        "file_id", "page", "start_line", "end_line", "header", "row_count", "repeated_headers"
    )


@query
def text_sufficiency(spark, sf_dir):
    """Extracted characters per conversation, one chunk per turn."""
    chunks = S.table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS file_id", "1 AS page", "cast(0 AS float) AS start_x",
        "cast(10 AS float) AS end_x", "cast(turn * 10 AS float) AS y",
        "text",
    )
    return C.character_counts(C.lines_to_cells(C.chunks_to_lines(chunks)))


# -- inference ---------------------------------------------------------------------------------


@query
def header_scores(spark, sf_dir):
    """Part names taken as headers, some of them made keyword-like."""
    headers = S.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 9 WHEN 0 THEN 'Posting Date' WHEN 1 THEN 'Memo/Details'
           WHEN 2 THEN 'AMOUNT ($)' WHEN 3 THEN 'Withdrawal' WHEN 4 THEN 'Credit/Debit'
           WHEN 5 THEN 'Category' WHEN 6 THEN 'Value' ELSE p_name END AS header""",
    )
    return inference.header_scores(headers, inference.CSV_KEYWORDS)


@query
def date_format_inference(spark, sf_dir):
    """Ten dates per sample in a hidden pattern; the first pattern that reads them all."""
    pattern = """CASE n % 5 WHEN 0 THEN date_format(d, 'MM/dd/yy') WHEN 1 THEN date_format(d, 'd/M/yyyy')
        WHEN 2 THEN date_format(d, 'yyyy-MM-dd') WHEN 3 THEN date_format(d, 'dd MMM yyyy HH:mm')
        ELSE concat('on ', d) END"""
    samples = (
        S.table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey div 10 AS n", "o_orderdate AS d")
        .withColumn("t", F.expr(pattern))
        .groupBy("n")
        .agg(F.collect_list("t").alias("values"))
    )
    found = inference.infer_date_format(F.col("values"))
    return samples.select("n", F.coalesce(found, F.lit("none")).alias("date_format"))


@query
def table_date_format(spark, sf_dir):
    shapes = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        """CASE o_orderkey % 8 WHEN 0 THEN date_format(o_orderdate, 'M/d/yy')
           WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'MM/dd')
           WHEN 3 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 4 THEN date_format(o_orderdate, 'MMM d')
           WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 6 THEN date_format(o_orderdate, 'MMM d yyyy')
           ELSE o_orderpriority END AS t""",
    )
    found = inference.infer_table_date_format(F.array(F.lit(" "), F.col("t")))
    return shapes.select("id", F.coalesce(found, F.lit("none")).alias("date_format"))


@query
def csv_mapping(spark, sf_dir):
    return inference.infer_csv_mapping(S.csv_files(spark, sf_dir, 3653)).select(
        "file_id", "headers", "date_column", "date_format", "description_column", "amount_column",
        "debit_column", "credit_column", "type_column", "category_column", "amount_mode",
        F.round("confidence", 6).alias("confidence"), "warnings",
    )


@query
def mapping_preview(spark, sf_dir):
    """Every rendered CSV file read under its own inferred mapping."""
    f = materialize(S.csv_files(spark, sf_dir, 3653))
    mappings = inference.infer_csv_mapping(f).withColumns(
        {"bank_name": F.lit("Any Bank"), "currency_iso_code": F.lit("usd")}
    )
    rows, status = inference.preview_csv_mapping(f, mappings, S.LATER)
    counted = rows.groupBy("file_id").agg(
        F.count("*").alias("rows"), F.sum("amount").cast("decimal(38,2)").alias("total")
    )
    zero = F.lit(0)
    return status.join(counted, "file_id", "left").select(
        "file_id", "status", "field",
        F.coalesce("rows", zero).alias("rows"),
        F.coalesce(F.col("total").cast("double"), zero.cast("double")).alias("total"),
    )


@query
def mapping_audit(spark, sf_dir):
    """Inferred mappings with faults put in, audited against their files."""
    f = S.csv_files(spark, sf_dir, 3653)
    number = F.regexp_extract("file_id", r"(\d+)", 1).cast("int")
    mappings = inference.infer_csv_mapping(f).withColumns(
        {
            "bank_name": F.when(number % 4 == 0, " ").otherwise("Bank"),
            "currency_iso_code": F.when(number % 5 == 0, "nope").otherwise("usd"),
            "date_column": F.when(number % 6 == 0, "Gone").otherwise(F.col("date_column")),
            "date_format": F.when(number % 7 == 0, "yy").otherwise(F.col("date_format")),
            "row_count": F.size("sample_rows"),
        }
    )
    return inference.csv_mapping_errors(mappings).select("file_id", "field", "message")


@query
def table_ranking(spark, sf_dir):
    lines = C.lines_to_cells(C.chunks_to_lines(materialize(S.table_chunks(spark, sf_dir))))
    ranked = inference.rank_table_candidates(C.detect_tables(lines))
    return ranked.select(
        "file_id", "candidate_id", "rank", "confidence", "date_header", "date_format",
        "description_header", "amount_mode", "amount_header", "debit_header", "credit_header",
        "negative_means", "rejection_reasons",
    )


@query
def table_analysis(spark, sf_dir):
    lines = materialize(C.lines_to_cells(C.chunks_to_lines(materialize(S.table_chunks(spark, sf_dir)))))
    ranked = inference.rank_table_candidates(C.detect_tables(lines))
    extracted = S.table(spark, sf_dir, "customer").selectExpr("concat('none-', c_custkey) AS file_id")
    every = lines.select("file_id").distinct().unionByName(extracted)
    return inference.table_analysis(ranked, every, C.character_counts(lines))


@query
def table_mapping_preview(spark, sf_dir):
    """Every rendered text table read under the mapping inferred for it."""
    chunks = materialize(S.table_chunks(spark, sf_dir))
    lines = materialize(C.lines_to_cells(C.chunks_to_lines(chunks)))
    best = inference.rank_table_candidates(C.detect_tables(lines)).where("rank = 1")
    mappings = best.select(
        "file_id",
        F.lit("Any Bank").alias("bank_name"),
        F.lit("usd").alias("currency_iso_code"),
        F.lit(None).cast("array<string>").alias("headerMustContain"),
        F.lit(None).cast("int").alias("minimumRows"),
        F.col("date_header").alias("dateHeader"),
        F.col("date_format").alias("dateFormat"),
        F.col("description_header").alias("descriptionHeader"),
        F.col("amount_header").alias("amountHeader"),
        F.col("debit_header").alias("debitHeader"),
        F.col("credit_header").alias("creditHeader"),
        F.col("type_header").alias("typeHeader"),
        F.coalesce("negative_means", F.when(F.col("amount_mode") == "SIGNED_AMOUNT", "CREDIT")).alias(
            "negativeMeans"
        ),
        F.lit("STATEMENT_PERIOD").alias("yearSource"),
    )
    _, status = inference.preview_table_mapping(lines, S.chunk_files(chunks), mappings)
    return status
