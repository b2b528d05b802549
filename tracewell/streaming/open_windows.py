"""Windows that have not ended yet, and how many rows came too late for theirs.

A stream gives a window once, when the watermark has passed its end. What it has
counted so far for the others lies in the state of its last checkpoint and is read
from there: the source isn't read again, and a row that came too late is in neither
part. Run these between two runs of the stream, not beside one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from tracewell import rules
from tracewell.streaming.live import GIVEN, READ

MAX_BATCHES = 10_000  # batches a counted run may have; their progress is kept by the driver


def _state(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """Keys and buffers of every open window; none before the first batch is done."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "commits/[0-9]*")
    done = commits.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(commits)
    if done is None or not len(done):
        return None
    return spark.read.format("statestore").load(checkpoint)


def _buffers(state: DataFrame, *names: str) -> DataFrame:
    """Keys of the state and its buffers, which are named here by their place.

    Two aggregates name their buffers alike, so ``value.*`` would mix them up; a
    cast between structs goes by place.
    """
    kinds = state.schema["value"].dataType
    named = StructType([StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)])
    return state.select("key", F.col("value").cast(named).alias("b")).select("key.*", "b.*")


def _mean(total: str, count: str, kind) -> Column:
    return F.try_divide(total, count).cast(kind)


def open_statements(stream: DataFrame, checkpoint: str, min_count: int = rules.MIN_COUNT) -> DataFrame:
    """The open windows of ``live.slow_statements`` as they stand, in its columns.

    ``stream`` is what was run with ``checkpoint``.
    """
    spark = stream.sparkSession
    state = _state(spark, checkpoint)
    if state is None:
        return spark.createDataFrame([], stream.schema)
    rows = _buffers(state, "sum", "valued", "count").where(F.col("count") > min_count)
    mean = _mean("sum", "valued", stream.schema["avg_duration"].dataType)
    return rows.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*", mean.alias("avg_duration")
    ).select(*stream.columns)


def open_bursts(stream: DataFrame, checkpoint: str) -> DataFrame:
    """The open runs of ``live.statement_bursts``, in its columns."""
    spark = stream.sparkSession
    state = _state(spark, checkpoint)
    if state is None:
        return spark.createDataFrame([], stream.schema)
    by = [c for c in stream.columns if c not in ("burst_start", "burst_end", "avg_duration", "count")]
    # the keys of a run stand among its buffers too
    rows = _buffers(state.withColumn("key", F.struct(F.lit(0))), "w", *by, "sum", "valued", "count")
    mean = _mean("sum", "valued", stream.schema["avg_duration"].dataType)
    return rows.select(
        F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "*", mean.alias("avg_duration")
    ).select(*stream.columns)


def open_breaker_alerts(
    stream: DataFrame, checkpoint: str, threshold_pct: float = rules.BREAKER_USED_PCT
) -> DataFrame:
    """The open windows of ``live.breaker_alerts`` above the threshold so far, in its columns."""
    spark = stream.sparkSession
    state = _state(spark, checkpoint)
    if state is None:
        return spark.createDataFrame([], stream.schema)
    rows = _buffers(state, "used", "used_rows", "limit", "limit_rows", "rows")
    return (
        rows.select(
            F.col("w.start").alias("window_start"),
            "node",
            _mean("used", "used_rows", stream.schema["avg_used"].dataType).alias("avg_used"),
            _mean("limit", "limit_rows", stream.schema["avg_limit"].dataType).alias("avg_limit"),
        )
        .withColumn("used_pct", F.try_divide("avg_used", "avg_limit") * 100)
        .where(F.col("used_pct") > threshold_pct)
        .select(*stream.columns)
    )


def top_per_window(rows: DataFrame, top_n: int = rules.TOP_STATEMENTS) -> DataFrame:
    """The slowest ``top_n`` statements of each window, ranked as ``live.run_top_per_window`` does."""
    order = Window.partitionBy("window_start", "window_end").orderBy(
        F.col("avg_duration").desc_nulls_first(), "statement"
    )
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def with_open(given: DataFrame, still_open: DataFrame) -> DataFrame:
    """Landed rows of a stream (``final`` true) and those of its open windows (``final`` false)."""
    return given.withColumn("final", F.lit(True)).unionByName(still_open.withColumn("final", F.lit(False)))


def _rows_open(spark: SparkSession, checkpoint: str) -> int:
    state = _state(spark, checkpoint)
    if state is None:
        return 0
    names = [f"b{i}" for i in range(len(state.schema["value"].dataType))]
    return _buffers(state, *names).agg(F.sum(names[-1])).first()[0] or 0


def run_counting_late(
    stream: DataFrame, run: Callable[[DataFrame], StreamingQuery], checkpoint: str
) -> int:
    """Run a windowed stream of ``live`` and return how many rows came too late.

    ``run`` is one of the ``run_`` functions with its other arguments bound.
    Counted is each row and window it falls into: what was open before and
    what was read, less what was given and what is open now. The counts of the
    query's own progress are smaller, since they are taken after rows of one
    window have been merged.
    """
    spark = stream.sparkSession
    before = _rows_open(spark, checkpoint)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    usual = spark.conf.get(kept)
    spark.conf.set(kept, str(MAX_BATCHES))
    try:
        progress = run(stream).recentProgress
    finally:
        spark.conf.set(kept, usual)
    if len(progress) >= MAX_BATCHES:
        raise ValueError(f"a run of {MAX_BATCHES} batches or more can't be counted")
    seen = {READ: 0, GIVEN: 0}
    for batch in progress:
        for name, row in (batch.observedMetrics or {}).items():
            seen[name] += row[0] or 0
    return before + seen[READ] - seen[GIVEN] - _rows_open(spark, checkpoint)
