"""Ranked statements and node health from raw logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import rules


def look_back(
    log: DataFrame,
    hours: float | None,
    as_of: datetime | str | Column | None = None,
    date_column: str | None = None,
) -> DataFrame:
    """Rows with ``ts >= as_of - hours``; no upper bound, ``hours=None`` keeps all.

    A literal ``as_of`` folds to a constant that reaches the Parquet scan. Where
    the log is partitioned by the date of ``ts``, name that column in
    ``date_column`` and older partitions are not even listed.
    """
    if hours is None:
        return log
    if as_of is None:
        as_of = F.current_timestamp()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of).cast("timestamp")
    cutoff = as_of - F.make_dt_interval(secs=F.lit(round(hours * 3600)))
    recent = log.where(F.col("ts") >= cutoff.cast(log.schema["ts"].dataType))
    return recent.where(F.col(date_column) >= cutoff.cast("date")) if date_column else recent


def statement_stats(log: DataFrame, by: tuple[str, ...] = ("index_name", "statement")) -> DataFrame:
    """Mean duration and count per statement.

    Both are summed before the shuffle, so a statement that makes up a third of
    the log sends one row per task.
    """
    return log.groupBy(*by).agg(
        F.avg("duration_ns").alias("avg_duration"), F.count(F.lit(1)).alias("count")
    )


def slowest_statements(
    log: DataFrame,
    hours: float | None = rules.LOOKBACK_HOURS,
    as_of: datetime | str | Column | None = None,
    min_count: int = rules.MIN_COUNT,
    top_n: int | None = rules.TOP_STATEMENTS,
    by: tuple[str, ...] = ("statement",),
    date_column: str | None = None,
) -> DataFrame:
    """Statements seen more than ``min_count`` times, slowest mean first.

    ``top_n=None`` returns them all, unsorted: the form the diagnosis uses.
    Ties go by statement text.
    """
    recent = look_back(log, hours, as_of, date_column)
    stats = statement_stats(recent, by).where(F.col("count") > min_count)
    stats = stats.select("avg_duration", "count", *by)
    if top_n is None:
        return stats
    return stats.orderBy(F.col("avg_duration").desc_nulls_first(), *by).limit(top_n)


def node_metrics(
    metrics: DataFrame,
    hours: float | None = rules.LOOKBACK_HOURS,
    as_of: datetime | str | Column | None = None,
    date_column: str | None = None,
) -> DataFrame:
    """Mean load per node, busiest first."""
    return (
        look_back(metrics, hours, as_of, date_column)
        .groupBy("node")
        .agg(
            F.avg("cpu_pct").alias("avg_cpu"),
            F.avg("mem_used_pct").alias("avg_mem_used"),
            F.avg("disk_read_kb").alias("avg_disk_io_read"),
            F.avg("disk_write_kb").alias("avg_disk_io_write"),
        )
        .orderBy(F.col("avg_cpu").desc_nulls_first(), "node")
    )


def breaker_hot_nodes(
    metrics: DataFrame,
    hours: float | None = None,
    as_of: datetime | str | Column | None = None,
    threshold_pct: float = rules.BREAKER_USED_PCT,
    date_column: str | None = None,
) -> DataFrame:
    """Nodes whose mean use is above a share of their mean limit, fullest first.

    The share is a ratio of means. A zero limit gives null, which is no alert.
    """
    return (
        look_back(metrics, hours, as_of, date_column)
        .groupBy("node")
        .agg(
            F.avg("breaker_used_bytes").alias("avg_used"),
            F.avg("breaker_limit_bytes").alias("avg_limit"),
        )
        .withColumn("used_pct", F.try_divide("avg_used", "avg_limit") * 100)
        .where(F.col("used_pct") > threshold_pct)
        .orderBy(F.col("used_pct").desc_nulls_first(), "node")
    )
