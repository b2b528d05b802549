from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cardinality, telemetry
from tracewell.sources import logs
from workload import views

NOW = datetime(2024, 1, 2)


def log(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, statement string, duration_ns bigint")


def test_look_back_is_inclusive_with_no_upper_bound(spark):
    rows = log(
        spark,
        [
            (NOW - timedelta(hours=1), "edge", 1),
            (NOW - timedelta(hours=1, seconds=1), "old", 1),
            (NOW + timedelta(days=9), "future", 1),
        ],
    )
    kept = {r.statement for r in telemetry.look_back(rows, 1, NOW).collect()}
    assert kept == {"edge", "future"}
    assert telemetry.look_back(rows, None).count() == 3
    half = telemetry.look_back(rows, 0.5, NOW).collect()
    assert [r.statement for r in half] == ["future"]


def test_count_limit_is_strict_and_order_is_total(spark):
    rows = [(NOW, "a", 10)] * 3 + [(NOW, "b", 20)] * 2 + [(NOW, "c", 10)] * 3 + [(NOW, "d", 5)] * 4
    out = telemetry.slowest_statements(log(spark, rows), 1, NOW, min_count=2, top_n=2)
    assert [tuple(r) for r in out.collect()] == [(10.0, 3, "a"), (10.0, 3, "c")]
    assert out.columns == ["avg_duration", "count", "statement"]


def test_null_mean_sorts_first(spark):
    rows = [(NOW, "a", None), (NOW, "b", 1)]
    out = telemetry.slowest_statements(log(spark, rows), 1, NOW, min_count=0)
    assert [r.statement for r in out.collect()] == ["a", "b"]


def test_breaker_share_is_a_ratio_of_means(spark):
    rows = spark.createDataFrame(
        [("n1", 10.0, 100.0), ("n1", 90.0, 20.0), ("n2", 70.0, 100.0), ("n3", 1.0, 0.0)],
        "node string, breaker_used_bytes double, breaker_limit_bytes double",
    )
    out = telemetry.breaker_hot_nodes(rows).collect()
    assert [(r.node, round(r.used_pct, 3)) for r in out] == [("n1", 83.333)]


def test_node_metrics_order(spark, sf):
    out = telemetry.node_metrics(views.node_metrics(spark, sf), None).collect()
    assert len(out) == 6
    assert [r.avg_cpu for r in out] == sorted((r.avg_cpu for r in out), reverse=True)


def test_filter_and_columns_reach_the_scan(spark, sf):
    out = telemetry.slowest_statements(views.slowlog(spark, sf), 336, views.AS_OF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-17T00:00" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
    assert "TakeOrderedAndProject" in plan and "partial_avg" in plan


def test_old_partitions_are_skipped(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(id) AS ts, id FROM range(9)")
    path = str(tmp_path / "log")
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    kept = telemetry.look_back(spark.read.parquet(path), 48, "2024-01-08", "day")
    assert kept.count() == 4
    assert kept.inputFiles() and len(kept.select("id").collect()) == 4
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day" in plan.split("PartitionFilters")[1]


def test_approximate_counts_are_close(spark, sf):
    tables = views.searched_tables(spark, sf)
    exact = cardinality.field_cardinality(tables, views.SEARCHED_FIELDS, exact=True)
    close = cardinality.field_cardinality(tables, views.SEARCHED_FIELDS)
    true = {(r.index_name, r.field_name): r.cardinality for r in exact.collect()}
    for row in close.collect():
        assert row.cardinality == pytest.approx(true[row.index_name, row.field_name], rel=0.05)


def test_referenced_fields_are_those_that_exist(spark, sf):
    clauses = spark.createDataFrame(
        [("events", "user_id"), ("events", "nope"), ("other", "user_id"), ("events", "user_id")],
        "index_name string, field string",
    )
    found = cardinality.referenced_fields(clauses, views.searched_tables(spark, sf))
    assert found == {"events": ["user_id"]}


def test_source_coverage(spark):
    rows = log(spark, [(NOW, "a", 1)])
    out = logs.source_coverage(["log", "empty", "gone"], {"log": rows, "empty": rows.limit(0)})
    got = {r.source: (r.present, r.row_count, r.latest_ts) for r in out.collect()}
    assert got == {"log": (True, 1, NOW), "empty": (False, 0, None), "gone": (False, 0, None)}


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame(
        [(NOW, "i", "s", 5, "m")],
        "ts timestamp, index_name string, statement string, duration_ns bigint, message string",
    )
    rows.write.parquet(str(tmp_path / ".ds-slow-1"))
    rows.write.parquet(str(tmp_path / ".ds-slow-2"))
    assert logs.read_slowlog(spark, str(tmp_path / ".ds-slow-*")).count() == 2
    stats = (
        "struct(struct(1 AS percent) AS cpu, struct(2 AS used_percent) AS mem) AS os, "
        "struct(struct(struct(3 AS read_kilobytes, 4 AS write_kilobytes) AS total) AS io_stats) AS fs, "
        "struct(struct(5 AS estimated_size_in_bytes, 6 AS limit_size_in_bytes) AS parent) AS breakers"
    )
    raw = spark.sql(
        "SELECT timestamp'2024-01-01' AS `@timestamp`, struct(struct('n' AS name, "
        f"struct({stats}) AS stats) AS node) AS elasticsearch"
    )
    (flat,) = logs.flatten_node_metrics(raw).collect()
    assert tuple(flat)[1:] == ("n", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


def test_tables_by_name_pattern(spark):
    spark.sql("DROP TABLE IF EXISTS slow_a1")
    spark.sql("DROP TABLE IF EXISTS slow_b2")
    spark.range(2).select("id", F.lit(1).alias("x")).write.saveAsTable("slow_a1")
    spark.range(3).write.saveAsTable("slow_b2")
    both = logs.read_tables_like(spark, "slow_?*")
    assert both.count() == 5 and both.where("x is null").count() == 3
    with pytest.raises(FileNotFoundError):
        logs.read_tables_like(spark, "nothing*")
    spark.sql("DROP TABLE slow_a1")
    spark.sql("DROP TABLE slow_b2")
