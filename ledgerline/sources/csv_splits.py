"""CSV statements of any size, read by splits of their files.

A line break inside quotes does not end a record, so where a record begins depends on how many quotes stand
before it in the file. Each split counts its own lines and quotes; a running sum over the splits of a file (a row
each) tells whether a split begins inside quotes and how many records stand before it. Then every line knows its record
without any task having read the file:

* a line that begins and ends outside quotes is a record; it stays where it is;
* the other lines are gathered by record, which is as large as the quoted text in it.

The names of the first record, and the mapping that they fit, go to the splits of the file, so that no join
brings a file's records together.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .csv_statements import attempts_of, csv_configs, csv_header_match, located, parsed_rows, REQUIRED, ROW_COLUMNS

SPLIT = ["file_id", "split"]


def read_csv_lines(spark: SparkSession, path: str, file_id: Column | None = None, **options) -> DataFrame:
    """``file_id, split, at, line`` of all files below a folder: a row each physical line, ``at`` its order in the split.

    Spark cuts the files (``spark.sql.files.maxPartitionBytes``); a split is known by its first byte. ``file_id``
    is an expression over ``path``, the path itself if not given. Carriage returns stay.
    """
    read = spark.read.options(recursiveFileLookup="true", **options).option("lineSep", "\n").text(path)
    lines = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.make_valid_utf8("value").alias("line"),
    )
    return lines.select((F.col("path") if file_id is None else file_id).alias("file_id"), "split", "at", "line")


def content_lines(files: DataFrame) -> DataFrame:
    """The same from files whose bytes are in a column ``content``: one split a file."""
    text = F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")
    lines = files.select("file_id", F.posexplode(text).alias("at", "line"))
    return lines.select("file_id", F.lit(0).cast("bigint").alias("split"), F.col("at").cast("bigint").alias("at"), "line")


def with_quote_counts(lines: DataFrame) -> DataFrame:
    """Lines with what their own split alone tells.

    ``quotes``: in the line; ``before``: earlier in the split; ``even`` and ``odd``: lines up to this one that
    follow an even and an odd number of quotes.
    """
    counted = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    so_far = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("quotes").over(so_far) - F.col("quotes")
    counted = counted.withColumn("before", before)
    inside = F.col("before") % 2
    return counted.withColumn("odd", F.sum(inside).over(so_far)).withColumn("even", F.count("*").over(so_far) - F.col("odd"))


def split_facts(counted: DataFrame) -> DataFrame:
    """``file_id, split, inside, records_before``: whether a split begins inside quotes, and the records that begin before it."""
    own = counted.groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd")
    )
    earlier = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    return own.select(*SPLIT, "inside", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("records_before"))


def records_by_split(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, splits): ``file_id, split, record_no, record`` in any order, and the facts of the splits.

    ``record_no`` counts from 1, blank records too. A record belongs to the split that its first line is in. One carriage return
    before the line break that ends a record is dropped.
    """
    counted = materialize(with_quote_counts(lines))
    splits = materialize(split_facts(counted))
    told = counted.join(splits, SPLIT)
    begins = (F.col("before") + F.col("inside")) % 2 == 0
    number = F.col("records_before") + F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    told = told.select(*SPLIT, "at", "line", "quotes", begins.alias("begins"), number.alias("record_no"))
    alone = F.col("begins") & (F.col("quotes") % 2 == 0)
    ended = lambda c: F.regexp_replace(c, r"\r\z", "")
    single = told.where(alone).select(*SPLIT, "record_no", ended(F.col("line")).alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("split", "at", "line")))
    several = (
        told.where(~alone)
        .groupBy("file_id", "record_no")
        .agg(parts.alias("parts"))
        .select("file_id", F.col("parts")[0]["split"].alias("split"), "record_no", ended(F.array_join("parts.line", "\n")).alias("record"))
    )
    return single.unionByName(several), splits.select(*SPLIT)


def parse_csv_splits(
    lines: DataFrame, files: DataFrame, formats: DataFrame, revisions: DataFrame, as_of: date
) -> tuple[DataFrame, DataFrame]:
    """Large files under all enabled CSV revisions of their format: (rows, attempts).

    ``lines`` as of ``read_csv_lines``; ``files``: file_id, filename, statement_format_id, account_id. Rows and attempts
    are those of ``parse_csv_statements``.
    """
    records, splits = records_by_split(lines)
    records = materialize(records)
    first = records.where("record_no = 1").select("file_id", F.col("record").alias("_first"))
    pairs = files.join(csv_configs(formats, revisions), "statement_format_id")
    fits = csv_header_match(F.col("filename"), F.col("_first"), *[F.col(name) for name in REQUIRED])
    handled = located(pairs.join(first, "file_id").where(fits), F.col("_first")).drop("_first")
    data = records.join(handled.join(splits, "file_id"), SPLIT)
    data = data.withColumn("_pos", (F.col("record_no") - 1).cast("int")).withColumnRenamed("record", "_record")
    parsed = materialize(parsed_rows(data, as_of))
    return parsed.where("not is_header and error is null").select(*ROW_COLUMNS), attempts_of(pairs, parsed)
