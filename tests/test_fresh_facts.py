"""Findings on a stream rest on what is known of the fields when a batch comes."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.operators import diagnosis, field_sketches
from tracewell.plans.cycle import field_facts
from tracewell.session import work_path
from tracewell.streaming import live

T0 = datetime(2024, 1, 1)
WILD = '{"query": {"wildcard": {"name": {"value": "a*b"}}}}'
CATALOG = "index_name string, field_name string, field_type string, refreshed_at timestamp"
LOG = "ts timestamp, index_name string, statement string, duration_ns long"


def values(spark, low, high, n=0):
    """A table with the names low..high on a day, each of them twice."""
    day = F.lit(date(2024, 1, 1) + timedelta(days=n))
    return spark.range(low, high).select(
        F.explode(F.transform(F.array("id", "id"), lambda x: x.cast("string"))).alias("name"), day.alias("day"), F.lit(None).cast("double").alias("none")
    )


def put(spark, path, table, index="t"):
    rows = field_sketches.day_sketches(table, index, ["name", "none"], F.col("day"))
    field_sketches.write_sketches(rows, path)


def counts(rows):
    return {(r.index_name, r.field_name): r.cardinality for r in rows.collect()}


def test_days_merge_and_are_replaced(spark):
    path = work_path(spark, "sketch-days")
    put(spark, path, values(spark, 0, 3000))
    put(spark, path, values(spark, 2000, 6000, 1))
    put(spark, path, values(spark, 0, 50, 1), "2024")  # a name that looks like a number
    got = counts(field_sketches.estimated_cardinality(spark, path))
    assert abs(got["t", "name"] - 6000) < 300 and got["t", "none"] == 0 and got["2024", "name"] == 50
    put(spark, path, values(spark, 2000, 4000, 1))  # the day again, as it is now
    got = counts(field_sketches.estimated_cardinality(spark, path))
    assert abs(got["t", "name"] - 4000) < 200 and got["2024", "name"] == 50
    later = field_sketches.estimated_cardinality(spark, path, F.lit("2024-01-02").cast("date"))
    assert abs(counts(later)["t", "name"] - 2000) < 100
    nameless = values(spark, 9000, 9100).withColumn("day", F.lit(None).cast("date"))
    put(spark, path, nameless)
    put(spark, path, nameless)
    assert abs(counts(field_sketches.estimated_cardinality(spark, path))["t", "name"] - 4100) < 205


def test_an_empty_table_has_no_sketch(spark):
    rows = field_sketches.day_sketches(values(spark, 0, 0), "t", ["name"], F.col("day"))
    assert rows.count() == 0


@pytest.mark.parametrize("n", [999, 1000, 1001, 9999, 10_000, 10_001])
def test_limits_are_decided_exactly(spark, n):
    path, table = work_path(spark, "sketch-limit"), values(spark, 0, n)
    put(spark, path, table)
    estimates = field_sketches.estimated_cardinality(spark, path)
    assert counts(field_sketches.settled_cardinality(estimates, {"t": table}))["t", "name"] == n


def test_far_from_a_limit_nothing_is_counted(spark):
    path, table = work_path(spark, "sketch-far"), values(spark, 0, 3000)
    put(spark, path, table)
    estimates = field_sketches.estimated_cardinality(spark, path)
    assert field_sketches.settled_cardinality(estimates, {"t": table}) is estimates


def log_of(spark, *statements):
    return spark.createDataFrame([(T0, "t", s, 1) for s in statements], LOG)


def test_facts_of_the_moment(spark):
    source, sketches, out, progress = (work_path(spark, n) for n in ("fl", "fs", "fo", "fp"))
    catalog = spark.createDataFrame([("t", "name", "keyword", T0)], CATALOG)
    facts = lambda: field_facts(catalog, field_sketches.estimated_cardinality(spark, sketches))

    def run():
        log = live.read_files(spark, source, LOG)
        live.run_live_findings(log, facts, out, progress)
        rows = spark.read.parquet(out).collect()
        return sorted((r.batch, r.code, r.field) for r in rows)

    put(spark, sketches, values(spark, 0, 100))
    log_of(spark, WILD, "plain", None).write.parquet(source)
    log_of(spark, "CircuitBreakingException", "CircuitBreakingException").write.mode("append").parquet(source)
    assert run() == [(0, rules.BREAKER, None)] * 2
    put(spark, sketches, values(spark, 0, 5000, 1))
    log_of(spark, WILD).write.mode("append").parquet(source)
    assert run() == [(0, rules.BREAKER, None)] * 2 + [(1, rules.HIGH_CARD, "name")]


@pytest.mark.parametrize("few", [True, False])
def test_rows_get_the_findings_of_their_statement(spark, monkeypatch, few):
    """Both ways of joining, with a hot statement and null keys, against the findings row by row."""
    if not few:
        monkeypatch.setattr(live, "MAX_BROADCAST_ROWS", 0)
    log = log_of(spark, *[WILD.replace("a*b", "*b")] * 40, "CircuitBreakingException", None, "plain")
    log = log.unionAll(spark.createDataFrame([(None, None, "CircuitBreakingException", None)], LOG))
    log = log.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    facts = diagnosis.measure_facts(
        spark.createDataFrame([("t", "name", "text", T0)], CATALOG),
        spark.createDataFrame([("t", "name", 20_000)], "index_name string, field_name string, cardinality long"),
    )
    row_by_row = live.live_findings(log, facts)
    at_once = live.findings_of_rows(log, facts)
    assert at_once.columns == row_by_row.columns
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, at_once.collect())) == sorted(map(key, row_by_row.collect()))
    assert at_once.count() > 80
