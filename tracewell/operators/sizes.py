"""Let measured sizes decide how small tables are joined."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import work_path

MAX_BROADCAST_ROWS = 200_000  # narrow lookup rows, about 20 MB
ARROW_BATCH = "2m"  # bytes that go to a Python worker at once


def broadcast_if_small(rows: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup for broadcast if it has at most ``max_rows`` rows.

    Starts a job that stops counting at the limit. A larger lookup comes back
    unmarked: it is then joined by a shuffle, where AQE splits hot keys.
    """
    return F.broadcast(rows) if rows.limit(max_rows + 1).count() <= max_rows else rows


def landed(rows: DataFrame, name: str) -> DataFrame:
    """Write an aggregate to the shared folder and read it back. Starts a job.

    It is computed once, outlives lost executors, and the planner knows its
    size from the files: a small one is broadcast before the large side of a
    join has been shuffled, which a decision at run time comes too late for.
    """
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table.landed_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete the files of landed tables that nothing reads any more.

    What was built on them must itself be landed: a lost executor's share of it
    can't be computed again from files that are gone.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.landed_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, each job's shuffle files go when it ends, not when the driver happens to collect its garbage.

    For work that lands what it reads again. A frame that is run twice still
    gives its rows, its shuffles are then made anew.
    """
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs hand texts to Python workers in batches of ``ARROW_BATCH``, not by up to 10,000 rows.

    A batch of whole texts is held several times over, by the JVM outside of its
    heap and by the worker. Frames that are run after it go by the session's setting.
    """
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH):
        yield


@contextmanager
def _set(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.set(setting, before)
