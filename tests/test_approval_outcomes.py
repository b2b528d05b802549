"""Approval outcomes from keyed state: files out of order, ties, repeats, what stays open."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.session import work_path
from tracewell.streaming import approvals, live

START = datetime(2024, 1, 1)
REQUEST = "approval_id string, ts timestamp, payload string"
DECISION = "approval_id string, decision_ts timestamp, decision string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, requests, decisions):
    """Each a list of files, each a list of rows; a file a batch."""
    folders = []
    for files, schema in ((requests, REQUEST), (decisions, DECISION)):
        path = work_path(spark, "approval-test")
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
        folders.append(path)
    streams = [
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
        for path, schema in zip(folders, (REQUEST, DECISION), strict=True)
    ]
    out = approvals.approval_outcomes(*streams, timeout_seconds=300, delay="100 seconds")
    path = work_path(spark, "approval-out")
    live.run_to_files(out, path, work_path(spark, "approval-progress"))
    done = spark.read.schema(out.schema).parquet(path)
    asked = spark.createDataFrame([r for f in requests for r in f], REQUEST)
    said = spark.createDataFrame([r for f in decisions for r in f], DECISION)
    last = F.lit(max(r[1] for f in requests + decisions for r in f if r[1]))
    return done, approvals.with_open_requests(done, asked, said, last, 300)


def test_first_decision_in_time_or_timeout(spark):
    requests = [
        [("a", at(0), "p"), ("b", at(0), None), ("c", at(10), "p"), ("c", at(10), "p"), (None, at(5), "p")],
        [("a", at(400), "again"), ("d", at(390), "q"), ("tie", at(400), "t")],
        [("late", at(2000), "x"), ("open", at(2000), "y")],
    ]
    decisions = [
        [("a", at(250), "rejected"), ("a", at(240), "approved"), ("c", at(9), "approved"), (None, at(6), "approved")],
        [("b", at(301), "approved"), ("c", at(310), "rejected"), ("d", at(391), "maybe"), ("a", at(400), "rejected")],
        [("tie", at(450), "rejected"), ("tie", at(450), "approved"), ("late", at(1999), "approved"), ("open", None, "approved")],
        [("late", at(2100), "approved")],
    ]
    done, everything = run(spark, requests, decisions)
    want = {
        ("a", "p", "approved"),
        ("b", None, "rejected_timeout"),
        ("c", "p", "rejected"),
        (None, "p", "rejected_timeout"),
        ("a", "again", "rejected"),
        ("d", "q", "rejected_timeout"),
        ("tie", "t", "approved"),
        ("late", "x", "approved"),
        ("open", "y", "open"),
    }
    rows = [(r.approval_id, r.payload, r.outcome) for r in everything.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    # what the watermark has passed came from the stream, and once
    live_rows = [(r.approval_id, r.payload, r.outcome) for r in done.collect()]
    assert len(live_rows) == len(set(live_rows)) and set(live_rows) <= want
    assert {("a", "p", "approved"), ("c", "p", "rejected"), ("b", None, "rejected_timeout")} <= set(live_rows)
    assert not any(r[0] in ("open", "late") for r in live_rows)


def test_decision_before_its_request_arrives(spark):
    requests = [[("z", at(1000), "p")], [("a", at(1005), "p")], [("z", at(5000), "p")]]
    decisions = [[("a", at(1010), "approved")], [("y", at(1020), "approved")], [("y", at(5000), "approved")]]
    _, everything = run(spark, requests, decisions)
    rows = {(r.approval_id, r.ts, r.outcome) for r in everything.collect()}
    assert rows == {("z", at(1000), "rejected_timeout"), ("a", at(1005), "approved"), ("z", at(5000), "open")}


def test_any_state_store_will_do(spark):
    """A session that names no provider has Spark's default one; ids that share a bucket don't mix."""
    name = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        ids = [f"id{i}" for i in range(3 * approvals.BUCKETS)]
        requests = [[(k, at(i % 7), "p") for i, k in enumerate(ids)], [("last", at(5000), "p")]]
        decisions = [[(k, at(10 + i % 400), "approved") for i, k in enumerate(ids)], [("other", at(5000), "approved")]]
        done, everything = run(spark, requests, decisions)
    finally:
        spark.conf.set(name, usual)
    want = {(k, "approved" if 10 + i % 400 <= 300 + i % 7 else "rejected_timeout") for i, k in enumerate(ids)}
    assert sorted((r.approval_id, r.outcome) for r in done.collect()) == sorted(want)
    assert everything.count() == len(ids) + 1


def test_requests_and_decisions_without_a_time(spark):
    requests = [[("a", None, "p"), ("a", at(5), "q")], [("z", at(5000), "p")]]
    decisions = [[("a", None, "rejected"), ("a", at(6), "approved")], [("y", at(5000), "approved")]]
    done, _ = run(spark, requests, decisions)
    rows = {(r.approval_id, r.ts, r.outcome) for r in done.collect()}
    assert rows == {("a", None, "rejected_timeout"), ("a", at(5), "approved")}
