"""Edge cases: nulls, odd vectors, time limits, numbering, missing sources."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tracewell import session
from tracewell.functions.ledger import decision_from_answer
from tracewell.operators import diagnosis, ledger, ranking, search
from tracewell.operators.latency import latency_stats
from tracewell.operators.telemetry import look_back
from tracewell.sources.logs import source_coverage
from tracewell.streaming import live


def test_look_back_is_exact_to_the_second(spark):
    log = spark.sql("SELECT timestamp '2024-01-01 00:57:30' AS ts, 1 AS n UNION ALL SELECT timestamp '2024-01-01 00:56:59', 2")
    kept = look_back(log, 2.05, "2024-01-01 03:00:00").collect()
    assert [r.n for r in kept] == [1]


def test_ranks_of_null_keys_and_hot_groups(spark):
    r = random.Random(3)
    rows = [(None, "baseline", r.paretovariate(0.5)) for _ in range(3000)]
    rows += [("q", None, 7.0)] * 40 + [("q", "x", float(i)) for i in (-5, 0, 3)] + [("big", "x", 1e300), ("big", "x", -1e300)]
    rows += [("nan", "x", math.nan), ("nan", "x", 1.0), ("gone", "x", None), ("inf", "x", 2.0)]
    frame = spark.createDataFrame(rows, "query string, variant string, elapsed_ms double")
    got = {(x.query, x.variant): (x.p95_ms, x.iterations) for x in latency_stats(frame).collect()}
    groups = {}
    for q, v, ms in rows:
        if ms is not None:
            groups.setdefault((q, v), []).append(ms)
    assert set(got) == set(groups)
    for key, values in groups.items():
        values.sort(key=lambda x: (math.isnan(x), x))
        want = values[min(int(len(values) * 0.95), len(values) - 1)]
        assert got[key][1] == len(values) and (got[key][0] == want or math.isnan(want) and math.isnan(got[key][0])), key


def test_numbered_rows(spark):
    frame = spark.range(500).select((F.col("id") * 7919 % 503).alias("x")).repartition(5)
    out = ranking.numbered_rows(frame, F.desc("x")).collect()
    assert [r.position for r in sorted(out, key=lambda r: -r.x)] == list(range(1, 501))
    assert ranking.numbered_rows(frame.limit(0), "x").collect() == []


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_vectors_that_are_no_numbers_displace_nothing(spark, most):
    rows = [(i, [math.nan, 1.0]) for i in range(30)] + [(100, [1.0, 0.0]), (101, [0.5, 0.0]), (102, None), (103, [math.inf, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    out = search.vector_topk(corpus, queries, 2, max_query_bytes=most).collect()
    assert [(r.query_id, r.rank, r.id) for r in out] == [(1, 1, 100), (1, 2, 101)]


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_uneven_vectors_raise(spark, most):
    corpus = spark.createDataFrame([(1, [1.0, 0.0, 9.0]), (2, [1.0])], "id long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="numbers, not 2"):
        search.vector_topk(corpus, queries, 2, max_query_bytes=most).collect()


def test_sources_that_are_not_there(spark):
    out = source_coverage(["a", "b"], {}).collect()
    assert sorted((r.source, r.present, r.row_count) for r in out) == [("a", False, 0), ("b", False, 0)]
    log = spark.sql("SELECT timestamp '2024-01-01' AS ts")
    assert [r.present for r in source_coverage(["a"], {"other": log}).collect()] == [False]


def test_answers_are_stripped(spark):
    rows = spark.createDataFrame([("\tyes",), ("Y\r\n",), (" no ",), (None,), ("",)], "a string")
    out = [r[0] for r in rows.select(decision_from_answer(F.col("a"))).collect()]
    assert out == ["approved", "approved", "rejected", "rejected", "rejected"]


def test_requests_time_out(spark):
    asked = spark.sql(
        "SELECT 'x' AS approval_id, timestamp '2024-01-01 10:00:00' AS ts, 'r' AS reason "
        "UNION ALL SELECT 'y', timestamp '2024-01-01 10:04:00', 'r' UNION ALL SELECT 'x', timestamp '2024-01-01 09:00:00', 'q'"
    )
    answers = spark.createDataFrame([], "approval_id string, decision string, decision_ts timestamp")
    assert {r.approval_id for r in ledger.pending_approvals(asked, answers).collect()} == {"x", "y"}
    still = ledger.pending_approvals(asked, answers, as_of="2024-01-01 10:06:00").collect()
    assert [r.approval_id for r in still] == ["y"]


def test_copies_that_never_end_time_out(spark):
    day = "2024-01-01"
    rows = [
        (w, s, "applied" if s in "ac" else "started", f"{day} 0{h}:00:00")
        for w, steps in {"late": "ab", "fresh": "ab", "skipped": "abc"}.items()
        for h, s in enumerate(steps, start=5 if w == "fresh" else 1)
    ]
    frame = spark.createDataFrame(rows, "workflow_id string, step string, status string, event_ts string")
    frame = frame.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    plain = {r.workflow_id: r.overall_status for r in ledger.workflow_status(frame).collect()}
    assert plain == {"late": "incomplete", "fresh": "incomplete", "skipped": "completed"}
    now = {r.workflow_id: r.overall_status for r in ledger.workflow_status(frame, as_of=f"{day} 06:30:00").collect()}
    assert now == {"late": "reindex_timeout", "fresh": "incomplete", "skipped": "reindex_timeout"}


def test_facts_without_a_name_change_nothing(spark):
    stats = spark.createDataFrame(
        [("logs", '{"query": {"wildcard": {"a": {"value": "*x"}}}}', 1e9, 5)],
        "index_name string, statement string, avg_duration double, count long",
    )
    types = spark.createDataFrame([("logs", "a", "keyword"), ("logs", None, "text"), (None, "a", "long")], "index_name string, field_name string, field_type string")
    counts = spark.createDataFrame([("logs", None, 99999)], "index_name string, field_name string, cardinality long")
    facts = diagnosis.measure_facts(types, counts)
    by_map = diagnosis.diagnose(stats, facts).drop("field_types").collect()
    by_join = diagnosis.diagnose(stats, diagnosis.Facts(facts.rows, facts.small, False)).drop("field_types").collect()
    assert by_map == by_join and by_map[0].affected_fields == ["a"]


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, key, default=None):
            return self.known.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session)
    Session.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})
    assert session.shared_dir(Session) == "hdfs:///x"


def test_a_page_that_lost_its_text_is_no_longer_served(spark):
    from tracewell.functions import vectors as vec

    folder = session.work_path(spark, "pages-in")
    long = "<title>T</title>" + "heap memory breaker limit " * 30
    schema = "url string, status int, html string"
    out, progress = session.work_path(spark, "kb"), session.work_path(spark, "kb-progress")
    for rows in ([("u", 200, long), ("v", 200, long)], [("u", 200, "gone"), ("v", 404, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        live.run_knowledge_base(spark.readStream.schema(schema).parquet(folder), out, progress, vec.hashed_tokens())
    assert {r.url for r in live.read_incremental_knowledge_base(spark, out).collect()} == {"v"}


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from tracewell.session import build_session
from tracewell.operators import search
spark = build_session("away", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"}})
v = spark.sql("SELECT 1L AS id, array(1.0f) AS embedding")
print(search.vector_topk(v, v.withColumnRenamed("id", "query_id"), 1).count())
"""
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "1", done.stderr[-2000:]
