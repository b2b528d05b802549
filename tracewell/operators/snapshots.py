"""Dated snapshots of the field catalogue, and its newest state kept up as they come.

A snapshot replaces the days it holds and no others. After each, the newest row of
every field is written for all days up to the last. A state is built from the one
before the snapshot's first day and the days since, so older days aren't read again,
also when a day is written anew or comes late.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.catalog import latest
from tracewell.operators.sizes import dropped, landed

NO_DAY = "0001-01-01"  # where rows without a time stand: any other row is newer
KEPT_STATES = 31


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _days(spark: SparkSession, path: str, marker: str = "") -> list[date]:
    """Days of the ``name=day`` folders under a path, in order; only those that hold ``marker``."""
    pattern, files = _folder(spark, f"{path}/*=*-*-*{marker and '/' + marker}")
    found = files.globStatus(pattern) or []
    names = [s.getPath().getParent().getName() if marker else s.getPath().getName() for s in found]
    return sorted(date.fromisoformat(name.split("=")[1]) for name in names)


def _states(spark: SparkSession, base: str) -> list[date]:
    return _days(spark, f"{base}/newest", "_SUCCESS")


def _delete_states(spark: SparkSession, base: str, states: list[date]) -> None:
    for state in states:
        folder, files = _folder(spark, f"{base}/newest/upto={state}")
        files.delete(folder, True)


def newest(spark: SparkSession, base: str) -> DataFrame:
    """Newest row per (index, field) over all snapshots, with its day as ``refreshed_on``.

    Reads the last state and the days after it, of which there are none unless
    an append was broken off. Equal times go by type name, as in ``latest``.
    """
    states = _states(spark, base)
    days = _days(spark, f"{base}/history")
    if not days:
        raise ValueError(f"no snapshot under {base}")
    if not states:
        return latest(_history(spark, base))
    state = spark.read.parquet(f"{base}/newest/upto={states[-1]}")
    if days[-1] <= states[-1]:
        return state
    later = _history(spark, base).where(F.col("refreshed_on") > states[-1])
    return latest(state.unionByName(later, allowMissingColumns=True))


def _history(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{base}/history")


def append_snapshot(catalog: DataFrame, base: str, kept_states: int = KEPT_STATES) -> None:
    """Write the days of ``catalog`` under ``base`` and bring the newest state up to date.

    ``catalog`` has index_name, field_name, field_type, refreshed_at and any other
    columns. A day that is there already is replaced as a whole, so a repeated
    append repeats no rows. No rows change nothing. Of the states, the last
    ``kept_states`` stay; a day before them is answered by reading all days.

    States that the new days outdate go first: whatever step a run is broken off
    at, ``newest`` then takes the days from the history. Starts jobs. One append
    at a time.
    """
    spark = catalog.sparkSession
    day = F.coalesce(F.to_date("refreshed_at"), F.lit(NO_DAY).cast("date"))
    rows = landed(catalog.withColumn("refreshed_on", day), "snapshot")
    first = rows.agg(F.min("refreshed_on")).first()[0]
    if first is not None:
        _delete_states(spark, base, [s for s in _states(spark, base) if s >= first])
        # the hint cuts a large day into even files and gives a small one a single file
        (
            rows.hint("rebalance", F.col("refreshed_on"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("refreshed_on")
            .parquet(f"{base}/history")
        )
        last = _days(spark, f"{base}/history")[-1]
        newest(spark, base).write.mode("overwrite").parquet(f"{base}/newest/upto={last}")
        _delete_states(spark, base, _states(spark, base)[:-kept_states])
    dropped(rows)
