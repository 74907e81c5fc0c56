"""Changes to stored transactions that rewrite only the files with rows they ask for.

The store is a folder written by ``append_transactions``: files below ``year=...``. Beside the rows, its
``_changes`` folder, which readers skip, holds an index of (file, block of ids). A change looks up the
blocks of the requested ids by an equi-join, reads the ids alone of the files found, and rewrites those that really
hold a requested id. All other files stay as they are, so the cost follows the change and not the table.

What reaches the driver are names of files, which Spark's own listing keeps there too; never ids or rows.

A change is prepared aside and then swapped in. The swap is written down first: a driver lost before that leaves
the table as it was, one lost later leaves a swap that ``finish_changes`` (which each change calls first) completes.
One change runs at a time, and readers wait for the swap, as for any rewrite of a folder of files.

Null and unknown ids find no file and get their outcome all the same; repeated ones count once for the choice of files.
An empty change set rewrites nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .changes import append_transactions, apply_patch, soft_delete

#: A block of the index is 65,536 ids: the index holds at most a row for each file and block of its range.
ID_BLOCK_BITS = 16
INDEX_ROW = "file string, block bigint"
Change = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def stored_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The table, without the column that only names folders."""
    return spark.read.parquet(path).drop("year")


def stored_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the table's files, written as ``_metadata.file_path`` writes them."""
    return [re.sub("^file:/+", "file:/", name) for name in spark.read.parquet(path).inputFiles()]


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in the words of Hadoop."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return [entry.getPath().toString() for entry in fs.listStatus(folder)] if fs.exists(folder) else []


def _read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*map(unquote, names))


def index_ids(spark: SparkSession, path: str) -> DataFrame:
    """The index, after adding the files that came since it was last used; of those only the ids are read.

    Rows of files that a change has replaced stay until ``drop_index``; look-ups pass over them.
    """
    index = f"{path}/_changes/ids"
    known: set[str] = set()
    if _children(spark, index):
        rows = spark.read.schema(INDEX_ROW).parquet(index)
        known = {r.file for r in rows.select("file").distinct().collect()}
    fresh = [name for name in stored_files(spark, path) if name not in known]
    if fresh or not known:
        ids = _read_files(spark, path, fresh) if fresh else spark.read.parquet(path)
        entries = ids.select(
            F.col("_metadata.file_path").alias("file"), F.shiftright("id", ID_BLOCK_BITS).alias("block")
        )
        entries.distinct().write.mode("append").parquet(index)
    return spark.read.schema(INDEX_ROW).parquet(index)


def drop_index(spark: SparkSession, path: str) -> None:
    """Forget the index; the next change makes it anew from the ids of all files."""
    fs, folder = _folder(spark, f"{path}/_changes/ids")
    fs.delete(folder, True)


def files_with(spark: SparkSession, path: str, ids: DataFrame) -> list[str]:
    """Names of the files that hold at least one of the ids (column ``id``)."""
    wanted = ids.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    blocks = wanted.select(F.shiftright("id", ID_BLOCK_BITS).alias("block")).distinct()
    found = index_ids(spark, path).join(blocks, "block", "left_semi").select("file").distinct()
    current = set(stored_files(spark, path))
    near = sorted({r.file for r in found.collect()} & current)
    if not near:
        return []
    rows = _read_files(spark, path, near).select("id", F.col("_metadata.file_path").alias("file"))
    return sorted(r.file for r in rows.join(wanted, "id", "left_semi").select("file").distinct().collect())


def change_stored(spark: SparkSession, path: str, ids: DataFrame, change: Change) -> DataFrame:
    """Apply a change to the stored rows of the files with any of the ids, and return its outcome.

    ``change`` takes rows and returns (all of them changed, outcome), as ``soft_delete`` and ``apply_patch`` do with
    their other arguments given; it may alter only rows whose id is among ``ids``.
    """
    finish_changes(spark, path)
    names = files_with(spark, path, ids)
    rows = _read_files(spark, path, names) if names else spark.read.parquet(path).where("false")
    new, outcome = change(rows.drop("year"))
    outcome = materialize(outcome)
    if names:
        aside = f"{path}/_changes/{uuid.uuid4().hex}"
        append_transactions(new, f"{aside}/rows")
        spark.createDataFrame([(name,) for name in names], "value string").write.text(f"{aside}/replaced")
        finish_changes(spark, path)
    return outcome


def finish_changes(spark: SparkSession, path: str) -> None:
    """Swap in what is prepared whole, and remove what is not. Doing so twice, or after a stop, is harmless."""
    for aside in _children(spark, f"{path}/_changes"):
        if aside.rstrip("/").endswith("/ids"):
            continue
        fs, folder = _folder(spark, aside)
        if fs.exists(_folder(spark, f"{aside}/replaced/_SUCCESS")[1]):
            for line in spark.read.text(f"{aside}/replaced").collect():
                fs.delete(_folder(spark, unquote(line.value))[1], False)
            for year in _children(spark, f"{aside}/rows"):
                name = year.rstrip("/").rsplit("/", 1)[1]
                if name.startswith("year="):
                    _move_files(spark, year, f"{path}/{name}")
        fs.delete(folder, True)


def _move_files(spark: SparkSession, source: str, target: str) -> None:
    fs, folder = _folder(spark, target)
    fs.mkdirs(folder)
    for name in _children(spark, source):
        moved = _folder(spark, f"{target}/{name.rsplit('/', 1)[1]}")[1]
        if not fs.rename(_folder(spark, name)[1], moved):
            raise OSError(f"cannot move {name} to {target}")


def soft_delete_stored(spark: SparkSession, path: str, requests: DataFrame, deleted_at: datetime) -> DataFrame:
    """``soft_delete`` on a stored table: the outcome of each request; the table is changed in place."""
    ids = requests.select(F.col("transaction_id").alias("id"))
    return change_stored(spark, path, ids, lambda rows: soft_delete(rows, requests, deleted_at))


def apply_patch_stored(spark: SparkSession, path: str, patches: DataFrame) -> DataFrame:
    """``apply_patch`` on a stored table: the outcome of each patch; the table is changed in place."""
    ids = patches.select(F.col("transaction_id").alias("id"))
    return change_stored(spark, path, ids, lambda rows: apply_patch(rows, patches))
