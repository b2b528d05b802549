"""Streams give what the batch operators give on the same files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.functions import vectors as vec
from tracewell.operators import ledger
from tracewell.session import shared_dir, work_path
from tracewell.streaming import live
from workload import queries

T0 = datetime(2024, 1, 1)
LOG = "ts timestamp_ntz, statement string, duration_ns long"


def write_files(spark, path, schema, *files):
    """Each list of rows becomes one file, in order of arrival."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def land(spark, stream, name):
    path = work_path(spark, name)
    live.run_to_files(stream, path, work_path(spark, name + "-progress"))
    return spark.read.schema(stream.schema).parquet(path)


def rows_at(*minutes, text="s", ns=1_000):
    return [(T0 + timedelta(minutes=m), text, ns) for m in minutes]


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    """Files arrive over several runs, with state kept in between."""
    source, out, progress = (work_path(spark, n) for n in ("late", "late-out", "late-progress"))

    def run():
        log = live.event_time(live.read_files(spark, source, LOG))
        live.run_to_files(live.slow_statements(log, min_count=0), out, progress)
        return {(r.window_start, r["count"]) for r in spark.read.parquet(out).collect()}

    write_files(spark, source, LOG, rows_at(5, 50))
    run()
    write_files(spark, source, LOG, rows_at(65, 59))  # 59 is within the delay
    run()
    write_files(spark, source, LOG, rows_at(120))
    assert run() == {(T0, 3)}
    write_files(spark, source, LOG, rows_at(10, 185))  # 10 is too late
    write_files(spark, source, LOG, rows_at(250))
    assert run() == {(T0, 3), *((T0 + timedelta(hours=h), 1) for h in (1, 2, 3))}


def test_windows_keep_the_count_limit(spark):
    source = work_path(spark, "limit")
    write_files(spark, source, LOG, rows_at(1, 2, 3) + rows_at(1, 2, text="few") + rows_at(900))
    log = live.event_time(live.read_files(spark, source, LOG))
    got = land(spark, live.slow_statements(log, min_count=2), "limit-out").collect()
    assert [(r.statement, r["count"], r.avg_duration) for r in got] == [("s", 3, 1000.0)]


def test_top_per_window_survives_a_second_run(spark):
    source, out, progress = (work_path(spark, n) for n in ("top", "top-out", "top-progress"))
    rows = [(T0 + timedelta(minutes=1), f"s{i}", i) for i in range(9)] + rows_at(300)
    write_files(spark, source, LOG, rows)

    def run():
        log = live.event_time(live.read_files(spark, source, LOG))
        live.run_top_per_window(live.slow_statements(log, min_count=0), out, progress, top_n=3)
        got = spark.read.parquet(out).orderBy("window_start", "rank").collect()
        return [(r.rank, r.statement) for r in got]

    assert run() == [(1, "s8"), (2, "s7"), (3, "s6")]
    write_files(spark, source, LOG, rows_at(900))
    assert run() == [(1, "s8"), (2, "s7"), (3, "s6"), (1, "s")]


def test_bursts(spark):
    source = work_path(spark, "bursts")
    write_files(spark, source, LOG, rows_at(0, 4, 8, 14, 15) + rows_at(900))
    log = live.event_time(live.read_files(spark, source, LOG))
    got = land(spark, live.statement_bursts(log), "bursts-out").collect()
    assert sorted((r.burst_start.minute, r["count"]) for r in got) == [(0, 3), (14, 2)]


def test_approvals_expire(spark):
    ask = "approval_id string, ts timestamp, reason string"
    answer = "approval_id string, decision_ts timestamp, decision string"
    asked, answered = work_path(spark, "asked"), work_path(spark, "answered")
    at = lambda s: T0 + timedelta(seconds=s)
    asks = [("a", at(0), "r"), ("b", at(0), "r"), ("c", at(0), "r"), ("d", at(0), "r"), ("z", at(90_000), "r")]
    answers = [("a", at(300), "approved"), ("b", at(301), "approved"), ("c", at(9), "approved"),
               ("c", at(7), "rejected"), ("z", at(90_000), "odd"), ("y", at(90_000), "approved")]
    write_files(spark, asked, ask, asks)
    write_files(spark, answered, answer, answers)
    stream = live.expiring_approvals(
        live.read_files(spark, asked, ask),
        live.read_files(spark, answered, answer),
    )
    rows = land(spark, stream, "expiring")
    assert rows.count() == 5
    got = {r.approval_id: r.outcome for r in live.first_outcomes(rows).collect()}
    batch = ledger.resolve_approvals(spark.createDataFrame(asks, ask), spark.createDataFrame(answers, answer))
    want = {r.approval_id: r.outcome for r in batch.collect()}
    del want["z"]  # its time has not passed
    assert got == want


def test_knowledge_base_grows_and_replaces(spark):
    schema = "url string, status int, html string"
    source, out, progress = (work_path(spark, n) for n in ("kbs", "kbs-out", "kbs-progress"))

    def run():
        pages = live.read_files(spark, source, schema)
        live.run_knowledge_base(pages, out, progress, vec.hashed_tokens(8))
        rows = live.read_incremental_knowledge_base(spark, out).collect()
        return {(r.url, r.chunk_idx): (r.title, len(r.text)) for r in rows}

    write_files(spark, source, schema, [("u", 200, "<title>A</title>" + "x" * 600), ("w", 500, "y" * 99)])
    assert run() == {("u", 0): ("A", 500), ("u", 1): ("A", 152)}
    write_files(spark, source, schema, [("u", 200, "<title>B</title>" + "x" * 400)])
    # the shorter page has one chunk: the old second one must not stay behind
    assert run() == {("u", 0): ("B", 402)}


def test_registered_streams_use_the_shared_folder(spark, sf):
    queries.stream_breaker_alert(spark, sf).count()
    assert shared_dir(spark) == shared_dir(spark)


def test_live_findings_equal_batch_findings(spark, sf):
    live_rows = queries.stream_findings(spark, sf).groupBy("statement").agg(
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")
    )
    batch = queries.findings(spark, sf).select(
        "statement", F.array_join(F.array_sort("anti_patterns.code"), ",").alias("codes")
    )
    assert set(map(tuple, live_rows.collect())) == set(map(tuple, batch.where("codes <> ''").collect()))
