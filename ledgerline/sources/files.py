"""Statement files: bytes, names, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_ascii
from ..operators.changes import prior_imports


def read_statement_files(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, length, content and ``error`` of every file below a folder, whatever its size.

    Spark's file sources list no files of length zero; ``check_files`` marks them in tables that have
    them.
    """
    every = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return check_files(every.select("path", name.alias("filename"), "length", "content"))


def check_files(files: DataFrame) -> DataFrame:
    """Files with a trimmed filename and an ``error`` code where one applies."""
    return files.withColumn("filename", trim_ascii(F.col("filename"))).withColumn(
        "error",
        F.when(is_blank(F.col("filename")), "MISSING_ORIGINAL_FILENAME")
        .when(F.col("length") == 0, "CSV_PARSING_ERROR"),
    )


def with_content_hash(files: DataFrame) -> DataFrame:
    """Lower-case hex SHA-256 of the bytes."""
    return files.withColumn("content_hash", F.sha2("content", 256))


def with_import_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (content, imported_by) with their earlier import, if any.

    Bytes are hashed on the map side and do not travel through the join.
    """
    return prior_imports(with_content_hash(files).drop("content"), ledger)
