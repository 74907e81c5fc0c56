"""Column types of the stored tables and of the JSON texts inside them."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("owner_id", T.StringType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("bank_name", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("currency_iso_code", T.StringType(), False),
        T.StructField("amount", T.DecimalType(38, 2), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("updated_by", T.StringType()),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("deleted_by", T.StringType()),
        T.StructField("file_import_id", T.LongType()),
    ]
)

FILE_IMPORT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("original_filename", T.StringType(), False),
        T.StructField("statement_format_id", T.LongType(), False),
        T.StructField("parser_revision_id", T.LongType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("file_size_bytes", T.LongType(), False),
        T.StructField("transaction_count", T.IntegerType(), False),
        T.StructField("imported_by", T.StringType(), False),
        T.StructField("imported_at", T.TimestampType(), False),
    ]
)

STATEMENT_FORMAT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("format_type", T.StringType(), False),
        T.StructField("bank_name", T.StringType(), False),
        T.StructField("default_currency_iso_code", T.StringType(), False),
        T.StructField("display_name", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("owner_id", T.StringType()),
        T.StructField("enabled", T.BooleanType(), False),
    ]
)

PARSER_REVISION = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("statement_format_id", T.LongType(), False),
        T.StructField("revision_number", T.IntegerType(), False),
        T.StructField("parser_type", T.StringType(), False),
        T.StructField("handler_key", T.StringType()),
        T.StructField("config_schema_version", T.IntegerType(), False),
        T.StructField("parser_config", T.StringType()),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("enabled", T.BooleanType(), False),
    ]
)

SAVED_VIEW = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("criteria", T.StringType()),
        T.StructField("open_ended", T.BooleanType(), False),
        T.StructField("pinned_ids", T.StringType()),
        T.StructField("excluded_ids", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STATEMENT_LINES = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("line_no", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

TEXT_CHUNKS = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("start_x", T.FloatType(), False),
        T.StructField("end_x", T.FloatType(), False),
        T.StructField("y", T.FloatType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

# JSON texts, as DDL for from_json.
VIEW_CRITERIA_JSON = (
    "dateFrom date, dateTo date, accountIds array<string>, bankNames array<string>, "
    "currencyIsoCodes array<string>, minAmount decimal(38,2), maxAmount decimal(38,2), "
    "type string, searchText string"
)
ID_SET_JSON = "array<bigint>"
CSV_CONFIG_JSON = (
    "dateHeader string, dateFormat string, descriptionHeader string, creditHeader string, "
    "debitHeader string, typeHeader string, categoryHeader string"
)
TABLE_CONFIG_JSON = (
    "fileType string, headerMustContain array<string>, minimumRows int, dateHeader string, "
    "dateFormat string, descriptionHeader string, amountHeader string, debitHeader string, "
    "creditHeader string, typeHeader string, negativeMeans string, yearSource string"
)

# Allowed values of the text columns that hold an enumeration.
ALLOWED = {
    "type": ["CREDIT", "DEBIT"],
    "format_type": ["CSV", "PDF", "XLSX"],
    "scope": ["SYSTEM", "USER"],
    "parser_type": ["STATIC_HANDLER", "CSV_COLUMN_CONFIG", "PDF_TEXT_TABLE_CONFIG"],
    "status": ["NOT_APPLICABLE", "MATCHED", "FAILED"],
}

PUBLIC_TRANSACTION_COLUMNS = [
    "id", "owner_id", "account_id", "bank_name", "date", "currency_iso_code",
    "amount", "type", "description", "created_at", "updated_at",
]
