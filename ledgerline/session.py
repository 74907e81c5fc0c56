"""Session settings shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """A ``local[...]`` session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerline")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, the one that ``DataFrame.checkpoint`` writes to.

    It is the shared folder that ``spark.checkpoint.dir`` names, on every master. Where that is unset, a
    session whose executors run in the driver, as in tests, gets one of its own; any other raises an
    error, because its executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ledgerline-checkpoint-"))
    return context.getCheckpointDir()


_steps: list[str] = []


def new_step_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    _steps.append(f"{ensure_checkpoint_dir(spark)}/step-{uuid.uuid4().hex}")
    return _steps[-1]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(settings).delete(folder, True)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Steps written inside the block go when it ends, so results must have been read or written by then.

    Outside any block, steps stay as long as the shared folder: a lazy result may still read them.
    """
    first = len(_steps)
    try:
        yield
    finally:
        _delete(spark, _steps[first:])
        del _steps[first:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Steps written inside the block go when it ends, but for those made with the function that it gives.

    For work whose last step needs none of the others.
    """
    first, kept = len(_steps), set()

    def keep(df: DataFrame) -> DataFrame:
        made = materialize(df)
        kept.add(_steps[-1])
        return made

    yield keep
    _delete(spark, [path for path in _steps[first:] if path not in kept])
    _steps[first:] = [path for path in _steps[first:] if path in kept]


#: Spark's setting that a query's shuffle files go when it ends; without it they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def shuffled(df: DataFrame) -> DataFrame:
    """The table as a side of a join that Spark does not broadcast.

    Spark takes a step for as large as its compressed files, and for no larger when its rows are multiplied, so what seems to
    be small enough may be a hundred times as large in the driver.
    """
    return df.hint("merge")


def materialize(df: DataFrame) -> DataFrame:
    """Write a step's result to the checkpoint folder as a table and go on from there.

    Later steps that use the result several times read it instead of computing it again, the plan
    stays small, the planner knows the true size, and the loss of executors costs nothing. Results
    built on a step read it when they run; ``steps`` bounds how long it stays. What was shuffled to make it is dropped.
    """
    spark = df.sparkSession
    path = new_step_folder(spark)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many tasks work that is costly for its bytes is dealt to."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_key(df: DataFrame, *columns: str) -> DataFrame:
    """Rows shuffled by key to a given number of tasks.

    Adaptive execution would join partitions up to its size in bytes, and so leave texts that are read or made at
    great cost for each row to a few tasks.
    """
    return df.repartition(tasks(df.sparkSession), *columns)
