"""The engine's tables, derived by Spark from the supplied star schema.

Statements are rendered from ``orders`` so that parsing them back can be compared with the source
rows. A rendered file holds a fixed number of orders, so files grow in number, not in size. Rendering
is costly per row, so it is spread over the tasks first; the small supplied files are one task each.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import by_key, new_step_folder

AS_OF = dt.date(2001, 1, 1)
VIEW_AS_OF = dt.date(2000, 6, 30)
LATER = dt.date(2024, 1, 1)
NOW = dt.datetime(2024, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.selectExpr(
        "o_orderkey AS id",
        "concat('usr_', o_custkey % 20) AS owner_id",
        "CASE WHEN o_custkey % 7 <> 0 THEN concat('acct-', o_custkey) END AS account_id",
        "n_name AS bank_name",
        "cast(o_orderdate AS date) AS date",
        """CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' WHEN 2 THEN 'EUR' WHEN 3 THEN 'CAD'
           ELSE 'GBP' END AS currency_iso_code""",
        "cast(round(o_totalprice, 2) AS decimal(38,2)) AS amount",
        "CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS type",
        """concat(c_mktsegment, ' payment ', o_orderpriority, ' REF ', o_orderkey % 1000)
           AS description""",
        "cast(o_orderdate AS timestamp) AS created_at",
        "CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderdate AS timestamp) END AS updated_at",
        "cast(NULL AS string) AS created_by",
        "cast(NULL AS string) AS updated_by",
        "o_orderkey % 11 = 0 AS deleted",
        "cast(NULL AS timestamp) AS deleted_at",
        "cast(NULL AS string) AS deleted_by",
        "cast(NULL AS bigint) AS file_import_id",
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two incoming rows for every transaction: altered, fuzzy, blocked, unrelated, equal."""
    tx = by_key(transactions(spark, sf_dir), "id")
    copies = tx.withColumn("copy", F.explode(F.expr("sequence(cast(id % 3 AS int), cast(id % 3 AS int) + 1)")))
    return copies.selectExpr(
        "owner_id",
        "concat('batch-', owner_id) AS batch_id",
        "id * 4 + copy AS row_pos",
        "date",
        """CASE (id + copy) % 5
             WHEN 0 THEN lower(replace(description, ' ', '-'))
             WHEN 1 THEN replace(description, 'payment', 'paymet')
             WHEN 2 THEN replace(description, 'REF ', 'REF 9')
             WHEN 3 THEN concat('unrelated merchant ', copy)
             ELSE description END AS description""",
        "amount",
        "type",
        "cast(NULL AS string) AS category",
        "bank_name",
        "currency_iso_code",
        "account_id",
        "(id + copy) % 13 = 0 AS allow_duplicate",
    )


def batch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per batch."""
    owners = table(spark, sf_dir, "customer").selectExpr("c_custkey % 20 AS n").distinct()
    return owners.selectExpr(
        "concat('usr_', n) AS owner_id",
        "concat('batch-usr_', n) AS batch_id",
        "n AS batch_seq",
        "sha2(concat('file-', n % 15), 256) AS content_hash",
        "concat('statement-', n, '.csv') AS original_filename",
        "cast(1 AS bigint) AS statement_format_id",
        "cast(1 AS bigint) AS parser_revision_id",
        "cast(NULL AS string) AS account_id",
        "cast(1000 + n AS bigint) AS file_size_bytes",
    )


def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier imports: one per customer, the file named by the customer's number."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 1 AS id",
        "sha2(concat('file-', c_custkey), 256) AS content_hash",
        "concat(c_name, '.csv') AS original_filename",
        "cast(1 + c_custkey % 3 AS bigint) AS statement_format_id",
        "cast(1 + c_custkey % 3 AS bigint) AS parser_revision_id",
        "CASE WHEN c_custkey % 5 <> 0 THEN concat('acct-', c_custkey) END AS account_id",
        "cast(100 + c_custkey AS bigint) AS file_size_bytes",
        "cast(c_custkey % 50 AS int) AS transaction_count",
        "concat('usr_', c_custkey % 20) AS imported_by",
        "timestamp'2001-01-01 00:00:00' AS imported_at",
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per order: the file named by the customer, sent by the customer's or next user."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS upload_id",
        "o_orderkey AS batch_seq",
        "sha2(concat('file-', o_custkey + (o_orderkey % 4) * 1000), 256) AS content_hash",
        "concat('usr_', (o_custkey + o_orderkey % 2) % 20) AS imported_by",
        "concat('upload-', o_orderkey, '.csv') AS original_filename",
        "cast(1 AS bigint) AS statement_format_id",
        "cast(1 AS bigint) AS parser_revision_id",
        "cast(NULL AS string) AS account_id",
        "cast(o_orderkey AS bigint) AS file_size_bytes",
        "cast(o_orderkey % 6 AS bigint) AS created",
    )


def saved_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('view-', s_suppkey) AS id",
        "concat('usr_', s_suppkey % 20) AS user_id",
        "s_name AS name",
        """CASE s_suppkey % 6
             WHEN 1 THEN '{"currencyIsoCodes":["usd"," "],"type":"DEBIT"}'
             WHEN 2 THEN '{"dateFrom":"1996-01-01","dateTo":"1998-12-31"}'
             WHEN 3 THEN '{"searchText":"building urgent"}'
             WHEN 4 THEN '{"minAmount":1000.00,"maxAmount":250000.00,"bankNames":["nation_1 xyz"]}'
             WHEN 5 THEN '{"accountIds":["acct-1",null],"searchText":" "}' END AS criteria""",
        "s_suppkey % 2 = 0 AS open_ended",
        "to_json(sequence(s_suppkey * 10, s_suppkey * 10 + 9)) AS pinned_ids",
        "to_json(sequence(s_suppkey * 10 + 5, s_suppkey * 10 + 30)) AS excluded_ids",
        "timestamp'2001-01-01 00:00:00' AS created_at",
        "timestamp'2001-01-01 00:00:00' AS updated_at",
    )


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('view-', event_id div 60) AS view_id",
        "event_id div 60 * 90 + event_id % 15 AS transaction_id",
        """CASE event_type WHEN 'click' THEN 'pin' WHEN 'view' THEN 'exclude'
           WHEN 'purchase' THEN 'unpin' WHEN 'signup' THEN 'unexclude' ELSE 'pin' END AS action""",
        "event_id AS seq",
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS request_id",
        "event_id AS pos",
        "event_id div 2 * 3 AS transaction_id",
        "concat('usr_', user_id % 20) AS actor",
        "event_type = 'error' AS can_act_on_any",
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "event_id div 3 * 4 AS transaction_id",
        "concat('usr_', user_id % 20) AS actor",
        "event_type IN ('error', 'signup') AS can_act_on_any",
        "CASE WHEN event_type <> 'purchase' THEN concat('patched ', event_id) END AS description",
        "CASE WHEN event_id % 3 = 0 THEN concat('acct-new-', user_id) END AS account_id",
    )


def statement_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 1 AS id",
        "CASE s_suppkey % 3 WHEN 0 THEN 'PDF' ELSE 'CSV' END AS format_type",
        "concat('Bank ', s_nationkey) AS bank_name",
        "CASE s_suppkey % 4 WHEN 0 THEN 'THB' ELSE 'USD' END AS default_currency_iso_code",
        "s_name AS display_name",
        "CASE WHEN s_suppkey % 10 = 0 THEN 'SYSTEM' ELSE 'USER' END AS scope",
        "CASE WHEN s_suppkey % 10 <> 0 THEN concat('usr_', s_suppkey % 20) END AS owner_id",
        "s_suppkey % 7 <> 0 AS enabled",
        "concat('key-', s_suppkey % 8) AS format_key",
        "CASE WHEN s_suppkey % 3 <> 0 THEN 'Date' END AS date_header",
        "CASE WHEN s_suppkey % 3 <> 0 THEN 'MM/dd/uu' END AS date_format",
        "CASE WHEN s_suppkey % 3 <> 0 THEN concat('Text \"', s_suppkey, '\"') END AS description_header",
        "CASE WHEN s_suppkey % 3 <> 0 THEN 'Credit' END AS credit_header",
        "CASE WHEN s_suppkey % 6 = 1 THEN 'Debit' END AS debit_header",
        "cast(NULL AS string) AS type_header",
        "cast(NULL AS string) AS category_header",
    )


def supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one small file for each supplier.

    A file costs much more than its bytes tell, so the number of tasks is given: adaptive execution would
    join these few bytes to one task that writes every file.
    """
    path = new_step_folder(spark)
    names = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS n", "s_name AS line")
    by_key(names, "n").write.partitionBy("n").text(path)
    return path


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .selectExpr("concat('usr_', c_custkey % 20) AS user_id")
        .distinct()
    )


def parser_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per (order, line number): the order is the file, the line number the revision."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("s"))
    )
    return lines.selectExpr(
        "cast(l_orderkey AS string) AS file_id",
        "l_orderkey * 10 + l_linenumber AS parser_revision_id",
        "l_linenumber % 2 AS priority",
        "l_linenumber AS revision_number",
        """CASE (l_orderkey + l_linenumber + s) % 5 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'FAILED'
           WHEN 2 THEN 'FAILED' ELSE 'NOT_APPLICABLE' END AS status""",
        "concat('failure ', l_linenumber) AS diagnostic",
        "cast(s AS int) AS row_count",
    )


# -- rendered statements -----------------------------------------------------------------------

CSV_FORMATS = [
    (1, "CSV", "Siam Bank", "THB", True),
    (2, "CSV", "First Bank", "USD", True),
    (3, "CSV", "Third Bank", "EUR", True),
]
CSV_REVISIONS = [
    (11, 1, 1, "Date", "dd/MM/uu", "Particulars", "Deposit", "Withdrawal", None, None),
    (12, 1, 2, "Missing", "dd/MM/uu", "Particulars", "Deposit", "Withdrawal", None, None),
    (21, 2, 1, "Transaction Date", "MM/dd/uuuu", "Transaction Description", "Transaction Amount",
     "Transaction Amount", "Transaction Type", "Category"),
    (31, 3, 1, "Posted", "d MMM uuuu HH:mm", "Memo", "Credit", "Debit", None, None),
]


def csv_catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Formats and revisions of the three rendered CSV layouts."""
    formats = spark.createDataFrame(
        CSV_FORMATS,
        "id bigint, format_type string, bank_name string, default_currency_iso_code string, "
        "enabled boolean",
    )
    rows = spark.createDataFrame(
        CSV_REVISIONS,
        "id bigint, statement_format_id bigint, revision_number int, date_header string, "
        "date_format string, description_header string, credit_header string, "
        "debit_header string, type_header string, category_header string",
    )
    from ..operators.formats import csv_config_json

    revisions = rows.select(
        "id",
        "statement_format_id",
        "revision_number",
        F.lit("CSV_COLUMN_CONFIG").alias("parser_type"),
        F.lit(None).cast("string").alias("handler_key"),
        csv_config_json(rows).alias("parser_config"),
        F.lit(0).alias("priority"),
        F.lit(True).alias("enabled"),
    )
    return formats, revisions


CSV_ROWS_PER_FILE = 50


CSV_LINE = """CASE n % 3
    WHEN 0 THEN concat_ws(',', date_format(d, 'dd/MM/yy'), concat('Order ', k, ' ', p),
      if(debit, format_string('%.2f', a), ''), if(debit, '', format_string('%.2f', a)))
    WHEN 1 THEN concat_ws(',', date_format(d, 'MM/dd/yyyy'),
      concat('"Order, ""', k, '"" ', if(k % 9 = 0, '\\nline two', 'one line'), '"'),
      concat('"$', format_number(a, 2), '"'), if(debit, 'Withdrawal', ' credit '), p)
    ELSE concat_ws(',', if(k % 5 = 0, date_format(d, 'd MMM yyyy'),
      concat(date_format(d, 'd MMM yyyy'), ' 14:05')), concat('Order ', k),
      if(debit, '', format_string('%.2f', a)), if(debit, format_string('%.2f', a), '')) END"""

CSV_HEADER = """CASE n % 3 WHEN 0 THEN 'Date,Particulars,Withdrawal,Deposit'
    WHEN 1 THEN 'Transaction Date,Transaction Description,Transaction Amount,Transaction Type,Category'
    ELSE 'Posted,Memo,Credit,Debit' END"""


def _csv_orders(spark: SparkSession, sf_dir: str, shift_days: int) -> DataFrame:
    return by_key(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr(
        f"o_orderkey div {CSV_ROWS_PER_FILE} AS n",
        "o_orderkey AS k",
        f"date_add(cast(o_orderdate AS date), {shift_days}) AS d",
        "round(o_totalprice, 2) AS a",
        "o_orderstatus = 'F' AS debit",
        "o_orderpriority AS p",
    )


def csv_files(spark: SparkSession, sf_dir: str, shift_days: int) -> DataFrame:
    """CSV statement files of 50 orders each, in three layouts: file_id, filename, content, ..."""
    orders = _csv_orders(spark, sf_dir, shift_days)
    files = (
        orders.withColumn("line", F.expr(CSV_LINE))
        .groupBy("n")
        .agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("rows"))
        .withColumn("header", F.expr(CSV_HEADER))
    )
    return files.selectExpr(
        "concat('csv-', n) AS file_id",
        "concat('Statement-', n, if(n % 2 = 0, '.csv', '.CSV')) AS filename",
        "cast(concat(header, '\\n', array_join(transform(rows, r -> r.line), '\\n'), '\\n') AS binary)"
        " AS content",
        "n % 3 + 1 AS statement_format_id",
        "concat('acct-', n) AS account_id",
    )


def large_csv_files(spark: SparkSession, sf_dir: str, shift_days: int) -> tuple[str, DataFrame]:
    """A folder with one CSV file a layout, all orders in them, and the table of the files (no content)."""
    orders = _csv_orders(spark, sf_dir, shift_days).selectExpr("n % 3 AS n", "k", f"{CSV_LINE} AS line")
    heads = spark.range(3).selectExpr("id AS n").selectExpr("n", "-1L AS k", f"{CSV_HEADER} AS line")
    path = new_step_folder(spark)
    rows = orders.unionByName(heads).withColumn("layout", F.col("n"))
    rows = rows.repartition("layout").sortWithinPartitions("layout", "k")
    rows.select("layout", "line").write.partitionBy("layout").text(path)
    files = spark.range(3).selectExpr(
        "concat('big-', id) AS file_id",
        "concat('Statement-', id, '.csv') AS filename",
        "id + 1 AS statement_format_id",
        "concat('acct-', id) AS account_id",
    )
    return path, files


_SIGNED_CONFIG = (
    '{"fileType":"TEXT_PDF","headerMustContain":["Date","Amount"],"minimumRows":2,'
    '"dateHeader":"Transaction Date","dateFormat":"MMM d","descriptionHeader":"Description",'
    '"amountHeader":"Amount","negativeMeans":"CREDIT","yearSource":"STATEMENT_PERIOD"}'
)
_SPLIT_CONFIG = (
    '{"fileType":"TEXT_PDF","headerMustContain":["Memo"],"minimumRows":1,'
    '"dateHeader":"Date","dateFormat":"dd/MM/uuuu","descriptionHeader":"Memo",'
    '"debitHeader":"Debit","creditHeader":"Credit","yearSource":"EXPLICIT_DATE"}'
)


def preview_catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Formats for the preview: for all, for one user, and disabled; with served and unserved revisions."""
    formats, revisions = csv_catalogue(spark)
    scoped = formats.withColumns(
        {
            "scope": F.when(F.col("id") == 2, "USER").otherwise("SYSTEM"),
            "owner_id": F.when(F.col("id") == 2, "usr_1"),
            "enabled": F.col("id") != 3,
        }
    )
    texts = spark.createDataFrame(
        [(i, "PDF", bank, code, True, "SYSTEM", None) for i, bank, code in PREVIEW_TEXT_FORMATS], scoped.schema
    )
    static = spark.createDataFrame(PREVIEW_TEXT_REVISIONS, revisions.schema)
    return scoped.unionByName(texts), revisions.unionByName(static)


PREVIEW_TEXT_FORMATS = [
    (4, "Capital One", "USD"), (5, "Capital One", "USD"), (6, "Bangkok Bank", "THB"), (7, "Table Bank", "USD"),
]
PREVIEW_TEXT_REVISIONS = [
    (41, 4, 1, "STATIC_HANDLER", "capital-one-credit-monthly-statement", None, 0, True),
    (42, 4, 2, "STATIC_HANDLER", "no-such-handler", None, 5, True),
    (43, 4, 3, "STATIC_HANDLER", "capital-one-bank-monthly-statement", None, 9, True),
    (71, 5, 1, "STATIC_HANDLER", "capital-one-credit-yearly-statement", None, 0, True),
    (72, 6, 1, "STATIC_HANDLER", "bkk-bank-statement-pdf", None, 0, True),
    (81, 7, 1, "PDF_TEXT_TABLE_CONFIG", None, _SIGNED_CONFIG, 0, True),
    (82, 7, 2, "PDF_TEXT_TABLE_CONFIG", None, _SPLIT_CONFIG, 0, True),
]


LINES_PER_FILE = 30


def _statement_rows(spark: SparkSession, sf_dir: str, per_file: int) -> DataFrame:
    """Orders as statement rows: file number n, day d within the file's period, amount text."""
    return by_key(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr(
        f"o_orderkey div {per_file} AS n",
        "o_orderkey AS k",
        f"make_date(cast(2005 + (o_orderkey div {per_file}) % 15 AS int),"
        f" cast(1 + (o_orderkey div {per_file}) % 12 AS int), 10) AS start",
        "o_orderstatus AS s",
        "o_orderpriority AS p",
        "round(o_totalprice, 2) AS a",
        "format_number(round(o_totalprice, 2), 2) AS money",
    ).withColumn("d", F.expr("date_add(start, cast(k % 30 AS int))"))


def _page_lines(rows: DataFrame, kind: str, *fixed: tuple[int, int, str]) -> DataFrame:
    """One copy of fixed lines per file: (page, line_no, SQL text expression over n and start)."""
    items = ", ".join(
        f"struct({page} AS page, {no} AS line_no, {text} AS text)" for page, no, text in fixed
    )
    return rows.select("n", "start").distinct().selectExpr(
        f"concat('{kind}-', n) AS file_id", f"inline(array({items}))"
    )


def _with_names(lines: DataFrame, kind: str) -> DataFrame:
    return lines.selectExpr(
        "file_id", "concat(file_id, '.pdf') AS filename", "cast(page AS int) AS page",
        "cast(line_no AS int) AS line_no", "text",
    )


_CARD_HEAD = (
    (1, 1, "'Capital One Platinum Credit Card'"),
    (1, 2, "'31 days in Billing Cycle'"),
    (1, 3, "concat('Statement Period: ', date_format(start, 'MMM d, yyyy'), ' - ',"
           " date_format(date_add(start, 30), 'MMM d, yyyy'))"),
    (1, 4, "'Payments, Credits and Adjustments'"),
    (1, 5, "'Trans Date Post Date Description Amount'"),
    (2, 1, "'Transactions'"),
    (2, 2, "'  Trans Date Post Date Description Amount'"),
    (2, 9000, "'Total Transactions for This Period $1.00'"),
)


def card_monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statement_rows(spark, sf_dir, LINES_PER_FILE)
    body = rows.selectExpr(
        "concat('card-', n) AS file_id",
        "if(s = 'F', 1, 2) AS page",
        f"10 + k % {LINES_PER_FILE} AS line_no",
        """concat(date_format(d, 'MMM d'), ' ', date_format(date_add(d, 1), 'MMM d'), ' Order ', k,
           ' ', p, if(k % 7 = 0, ' - $', ' $'), money) AS text""",
    )
    return _with_names(body.unionByName(_page_lines(rows, "card", *_CARD_HEAD)), "card")


def card_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card statement with every column on a line of its own."""
    rows = _statement_rows(spark, sf_dir, LINES_PER_FILE)
    body = rows.selectExpr(
        "concat('split-', n) AS file_id",
        "if(s = 'F', 1, 2) AS page",
        f"10 + (k % {LINES_PER_FILE}) * 10 AS base",
        """array(date_format(d, 'MMM d'), date_format(date_add(d, 1), 'MMM d'),
           concat('Order ', k), p, concat(if(k % 7 = 0, '- $', '$'), money)) AS parts""",
    ).selectExpr("file_id", "page", "base", "posexplode(parts) AS (i, text)")
    lines = body.selectExpr("file_id", "page", "base + i AS line_no", "text")
    head = [x for x in _CARD_HEAD if x[1] not in (5, 2) or x[0] == 1]
    closing = (3, 1, "'Fees'")
    return _with_names(lines.unionByName(_page_lines(rows, "split", *head, closing)), "split")


def bank_monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statement_rows(spark, sf_dir, LINES_PER_FILE)
    body = rows.selectExpr(
        "concat('bank-', n) AS file_id",
        "if(s = 'F', 1, 2) AS page",
        f"10 + k % {LINES_PER_FILE} AS line_no",
        """concat(date_format(d, 'MMM d'), ' Order ', k, ' ', p,
           if(s = 'O', ' Credit + $', ' Debit - $'), money, ' $9,999.99') AS text""",
    )
    fixed = (
        (1, 1, "'Capital One 360 - here is your'"),
        (1, 2, "'monthly bank statement'"),
        (1, 3, "concat(date_format(start, 'MMM d'), ' - ',"
               " date_format(date_add(start, 30), 'MMM d, yyyy'))"),
        (1, 4, "concat('360 Checking - 3601234', cast(5000 + n % 1000 AS string))"),
        (1, 5, "'DATE DESCRIPTION CATEGORY AMOUNT BALANCE'"),
        (2, 1, "'Savings Now - 987'"),
        (2, 9000, "'Closing Balance $1.00'"),
    )
    return _with_names(body.unionByName(_page_lines(rows, "bank", *fixed)), "bank")


def card_yearly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statement_rows(spark, sf_dir, LINES_PER_FILE)
    body = rows.selectExpr(
        "concat('year-', n) AS file_id",
        "if(s = 'F', 2, 3) AS page",
        f"10 + k % {LINES_PER_FILE} AS line_no",
        "concat(date_format(d, 'MM/dd'), ' Order ', k, ' ', if(k % 7 = 0, '-$', '$'), money) AS text",
    )
    fixed = (
        (1, 1, "'Capital One'"),
        (1, 2, "concat('Year-End Summary ', year(start))"),
        (1, 3, "'Merchandise'"),
        (1, 4, "'01/01 ROW BEFORE THE DETAILS $1.00'"),
        (2, 1, "'Section 4: Transaction Details'"),
        (2, 2, "'Dining'"),
        (3, 1, "'travel/airfare'"),
        (3, 9000, "'TOTAL CHARGES $1.00'"),
    )
    return _with_names(body.unionByName(_page_lines(rows, "year", *fixed)), "year")


def _chunks(rows: DataFrame, kind: str, parts: str) -> DataFrame:
    """Positioned text of rows: an SQL array of (x, end, text) per row, at height y of a page."""
    return rows.selectExpr(
        f"concat('{kind}-', n) AS file_id", "page", "y", f"inline({parts})"
    ).selectExpr(
        "file_id", "cast(page AS int) AS page", "cast(x AS float) AS start_x",
        "cast(e AS float) AS end_x", "cast(y AS float) AS y", "text",
    )


CHUNK_ROWS_PER_FILE = 20


def two_column_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawal and deposit columns; the heights of one line differ by up to 1.2 points."""
    rows = _statement_rows(spark, sf_dir, CHUNK_ROWS_PER_FILE).selectExpr(
        "*", "if(s = 'F', 1, 2) AS page", f"100 + 20 * (k % {CHUNK_ROWS_PER_FILE}) AS y"
    )
    cell = "named_struct('x', cast({x} AS double), 'e', cast({e} AS double), 'text', {t})"
    money_at = "if(s = 'O', 490, 390)"
    date = cell.format(x=50, e=90, t="date_format(d, 'dd/MM/yy')")
    body = _chunks(
        rows, "two",
        f"array({date}, {cell.format(x=120, e=160, t="'Order'")},"
        f" {cell.format(x=165, e=200, t='cast(k AS string)')})",
    )
    amounts = _chunks(
        rows.withColumn("y", F.expr("y + 1.2")), "two",
        f"array({cell.format(x=f'{money_at} - 30', e=money_at, t='money')},"
        f" {cell.format(x=530, e=565, t="'1,000.00'")})",
    )
    words = {"Date": 50, "Particulars": 120, "Chq.No.": 260, "Withdrawal": 330, "Deposit": 430,
             "Balance": 520, "Via": 570}
    header = ", ".join(cell.format(x=x, e=x + 40, t=f"'{w}'") for w, x in words.items())
    heads = rows.select("n").distinct()
    top = _chunks(
        heads.selectExpr("n", "1 AS page", "60 AS y"), "two",
        f"array({cell.format(x=50, e=200, t="'Bangkok  Bank statement'")})",
    )
    title = _chunks(heads.selectExpr("n", "1 AS page", "80 AS y"), "two", f"array({header})")
    forward = _chunks(
        heads.selectExpr("n", "1 AS page", "90 AS y"), "two",
        f"array({cell.format(x=50, e=90, t="'01/01/26'")}, {cell.format(x=120, e=150, t="'B/F'")},"
        f" {cell.format(x=530, e=565, t="'1,000.00'")})",
    )
    out = body
    for part in (amounts, top, title, forward):
        out = out.unionByName(part)
    return out


def two_column_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statement when every line came out as one chunk of text."""
    rows = _statement_rows(spark, sf_dir, CHUNK_ROWS_PER_FILE).selectExpr(
        "*", "1 AS page", f"100 + 20 * (k % {CHUNK_ROWS_PER_FILE}) AS y"
    )
    cell = "named_struct('x', cast(50 AS double), 'e', cast(500 AS double), 'text', {t})"
    body = _chunks(
        rows, "txt",
        "array(" + cell.format(
            t="concat(date_format(d, 'dd/MM/yy'), ' Order ', rpad(cast(k AS string), 20, ' '),"
              " if(s = 'O', repeat(' ', 15), ''), money, if(s = 'O', ' ', repeat(' ', 16)),"
              " repeat(' ', 15), '1,000.00')"
        ) + ")",
    )
    heads = rows.select("n").distinct()
    title = _chunks(
        heads.selectExpr("n", "1 AS page", "80 AS y"), "txt",
        "array(" + cell.format(
            t="concat('Date     Particulars', repeat(' ', 10), 'Withdrawal     Deposit ',"
              " repeat(' ', 14), 'Balance')"
        ) + ")",
    )
    top = _chunks(
        heads.selectExpr("n", "1 AS page", "60 AS y"), "txt",
        "array(" + cell.format(t="'Bangkok Bank'") + ")",
    )
    return body.unionByName(title).unionByName(top)


TABLE_FORMATS = [(1, "PDF", "Table Bank", "USD", True), (2, "PDF", "Column Bank", "EUR", True)]
TABLE_REVISIONS = [(51, 1, 1, _SIGNED_CONFIG), (61, 2, 1, _SPLIT_CONFIG)]


def table_catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    formats = spark.createDataFrame(
        TABLE_FORMATS,
        "id bigint, format_type string, bank_name string, default_currency_iso_code string, "
        "enabled boolean",
    )
    rows = spark.createDataFrame(
        TABLE_REVISIONS,
        "id bigint, statement_format_id bigint, revision_number int, parser_config string",
    )
    return formats, rows.selectExpr(
        "id", "statement_format_id", "revision_number",
        "'PDF_TEXT_TABLE_CONFIG' AS parser_type", "cast(NULL AS string) AS handler_key",
        "parser_config", "0 AS priority", "true AS enabled",
    )


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables of two layouts, by file number: a signed amount with a split header and yearless
    dates, and debit and credit columns with a repeated header."""
    rows = _statement_rows(spark, sf_dir, CHUNK_ROWS_PER_FILE).selectExpr(
        "*", "1 AS page", f"100 + 12 * (k % {CHUNK_ROWS_PER_FILE}) AS y"
    ).where("n % 2 in (0, 1)")
    cell = "named_struct('x', cast({x} AS double), 'e', cast({e} AS double), 'text', {t})"
    signed = (
        f"array({cell.format(x=50, e=80, t="date_format(d, 'MMM d')")},"
        f" {cell.format(x=150, e=180, t="'Order'")}, {cell.format(x=185, e=220, t='cast(k AS string)')},"
        f" {cell.format(x=400, e=440, t="concat(if(k % 7 = 0, '-$', '$'), money)")})"
    )
    double = (
        f"array({cell.format(x=50, e=100, t="date_format(d, 'dd/MM/yyyy')")},"
        f" {cell.format(x=150, e=220, t="concat('Order ', k)")},"
        f" {cell.format(x="if(s = 'O', 395, 300)", e="if(s = 'O', 435, 340)", t='money')})"
    )
    header = (
        f"array({cell.format(x=50, e=80, t="'Date'")}, {cell.format(x=150, e=200, t="'Memo'")},"
        f" {cell.format(x=300, e=340, t="'Debit'")}, {cell.format(x=395, e=435, t="'Credit'")})"
    )
    line = "named_struct('y', {y}, 'parts', {parts})"
    above_one = ", ".join(
        [
            line.format(y=20, parts=f"array({cell.format(x=50, e=200, t="concat('Statement of ', year(start))")})"),
            line.format(y=76, parts=f"array({cell.format(x=50, e=110, t="'Transaction'")})"),
            line.format(
                y=88,
                parts=f"array({cell.format(x=50, e=80, t="'Date'")},"
                f" {cell.format(x=150, e=220, t="'Description'")},"
                f" {cell.format(x=400, e=440, t="'Amount'")})",
            ),
        ]
    )
    above_two = ", ".join(line.format(y=y, parts=header) for y in (88, 94))
    heads = rows.select("n", "start").distinct().selectExpr(
        "n", "1 AS page", f"inline(if(n % 2 = 0, array({above_one}), array({above_two})))"
    )
    body = _chunks(rows, "tab", f"if(n % 2 = 0, {signed}, {double})")
    return body.unionByName(_chunks(heads, "tab", "parts"))


def table_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every order that ``table_chunks`` renders."""
    return table(spark, sf_dir, "orders").selectExpr(f"o_orderkey div {CHUNK_ROWS_PER_FILE} AS n").where(
        "n % 2 in (0, 1)"
    ).selectExpr("concat('tab-', n) AS file_id")


def chunk_files(chunks: DataFrame, formats: int = 0) -> DataFrame:
    """File rows of rendered chunks; with ``formats``, the file number picks the format."""
    number = "cast(element_at(split(file_id, '-'), -1) AS bigint)"
    chosen = f"{number} % {formats} + 1" if formats else "cast(NULL AS bigint)"
    return chunks.select("file_id").distinct().selectExpr(
        "file_id", "concat(file_id, '.pdf') AS filename",
        f"{chosen} AS statement_format_id",
        f"concat('acct-', {number}) AS account_id",
    )
