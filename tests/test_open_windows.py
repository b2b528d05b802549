"""What a stream gave and its open windows together are the batch, but for rows that came too late."""

from datetime import datetime, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from tracewell.session import work_path
from tracewell.streaming import live, open_windows

T0 = datetime(2024, 1, 1)
LOG = "ts timestamp_ntz, statement string, duration_ns long"


def at(*minutes, text="s", ns=1_000):
    return [(T0 + timedelta(minutes=m), text, ns) for m in minutes]


def arrive(spark, path, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def places(spark):
    return [work_path(spark, n) for n in ("open", "open-out", "open-progress")]


def run(stream, out, progress):
    late = open_windows.run_counting_late(
        stream, partial(live.run_to_files, path=out, checkpoint=progress), progress
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(out), late


def batch(spark, source, length, slide=None, by=("statement",)):
    rows = spark.read.schema(LOG).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(w.alias("w"), *by).agg(F.avg("duration_ns").alias("a"), F.count(F.lit(1)).alias("n"))
    return {(r.w.start, *(r[c] for c in by), r.a, r.n) for r in out.collect()}


def as_set(rows, by=("statement",)):
    return {(r.window_start, *(r[c] for c in by), r.avg_duration, r["count"]) for r in rows.collect()}


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_given_and_open_are_the_batch(spark, places, slide):
    """Files out of order, null keys, times and durations, a statement with half of all rows."""
    source, out, progress = places
    arrive(spark, source, at(5, 50) + at(*range(60), text="hot") + [(None, "s", 1)])
    stream = live.slow_statements(
        live.event_time(live.read_files(spark, source, LOG)), "1 hour", slide, min_count=0
    )
    assert run(stream, out, progress)[1] == 0
    arrive(spark, source, at(65, 59) + at(70, text=None, ns=5) + at(71, 72, ns=None))
    assert run(stream, out, progress)[1] == 0
    arrive(spark, source, at(118, 61, ns=7) + at(119, text="hot"))
    given, late = run(stream, out, progress)
    both = open_windows.with_open(given, open_windows.open_statements(stream, progress, min_count=0))
    assert late == 0
    assert as_set(both) == batch(spark, source, "1 hour", slide)
    assert both.where("final").count() == given.count() > 0
    assert both.where("not final").agg(F.min("window_end")).first()[0] > T0 + timedelta(minutes=109)


def test_late_rows_are_counted(spark, places):
    source, out, progress = places
    arrive(spark, source, at(5, 50))
    stream = live.slow_statements(live.event_time(live.read_files(spark, source, LOG)), min_count=1)
    run(stream, out, progress)
    arrive(spark, source, at(200))
    run(stream, out, progress)
    # three rows of one window and statement, which the query's own progress counts as one
    arrive(spark, source, at(10, 11, 12) + at(13, text="t") + at(201))
    given, late = run(stream, out, progress)
    assert late == 4
    assert as_set(given) == {(T0, "s", 1000.0, 2)}
    left = open_windows.open_statements(stream, progress, min_count=1)
    assert as_set(left) == {(T0 + timedelta(hours=3), "s", 1000.0, 2)}
    assert open_windows.open_statements(stream, progress, min_count=2).count() == 0
    assert run(stream, out, progress)[1] == 0  # nothing new


def test_nothing_arrived(spark, places):
    source, _, progress = places
    spark.createDataFrame([], LOG).write.parquet(source)
    log = live.event_time(live.read_files(spark, source, LOG))
    for stream, still_open in (
        (live.slow_statements(log), open_windows.open_statements),
        (live.statement_bursts(log), open_windows.open_bursts),
    ):
        left = still_open(stream, progress)
        assert left.columns == stream.columns and left.count() == 0


def test_bursts(spark, places):
    source, out, progress = places
    arrive(spark, source, at(0, 4, 8, 40) + at(41, text=None, ns=None))
    stream = live.statement_bursts(live.event_time(live.read_files(spark, source, LOG)))
    given, late = run(stream, out, progress)
    both = open_windows.with_open(given, open_windows.open_bursts(stream, progress)).collect()
    found = {(r.burst_start.minute, r.burst_end.minute, r.statement, r.avg_duration, r["count"], r.final) for r in both}
    assert found == {(0, 13, "s", 1000.0, 3, True), (40, 45, "s", 1000.0, 1, False), (41, 46, None, None, 1, False)}
    arrive(spark, source, at(2, 3) + at(43))
    given, late = run(stream, out, progress)
    assert late == 2
    (s,) = open_windows.open_bursts(stream, progress).where("statement = 's'").collect()
    assert (s.burst_start.minute, s.burst_end.minute, s["count"]) == (40, 48, 2)


def test_breaker(spark, places):
    source, out, progress = places
    schema = "ts timestamp, node string, breaker_used_bytes double, breaker_limit_bytes double"
    rows = [(T0, "a", 80.0, 100.0), (T0, "a", 90.0, 100.0), (T0, "a", None, 100.0), (T0, "b", 10.0, 100.0)]
    arrive(spark, source, rows, schema)
    stream = live.breaker_alerts(live.read_files(spark, source, schema))
    given, late = run(stream, out, progress)
    assert (given.count(), late) == (0, 0)
    left = [tuple(r) for r in open_windows.open_breaker_alerts(stream, progress).collect()]
    assert left == [(T0, "a", 85.0, 100.0, 85.0)]


def test_top_of_open_windows(spark, places):
    source, out, progress = places
    arrive(spark, source, [(T0, f"s{i}", i // 2) for i in range(9)] + [(T0, None, None)])
    stream = live.slow_statements(live.event_time(live.read_files(spark, source, LOG)), min_count=0)
    late = open_windows.run_counting_late(
        stream, partial(live.run_top_per_window, path=out, checkpoint=progress, top_n=3), progress
    )
    left = open_windows.top_per_window(open_windows.open_statements(stream, progress, min_count=0), 3)
    # a mean that is unknown comes first, as in the batch; ties go by name
    assert [(r.rank, r.statement) for r in left.orderBy("rank").collect()] == [(1, None), (2, "s8"), (3, "s6")]
    assert late == 0
