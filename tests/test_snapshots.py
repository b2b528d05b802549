"""The newest catalogue kept from dated snapshots is the newest over all of them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import catalog, snapshots
from tracewell.session import work_path

T0 = datetime(2024, 1, 1, 8)
SCHEMA = "index_name string, field_name string, field_type string, settings map<string,string>, refreshed_at timestamp"


def day(n, hour=0):
    return T0 + timedelta(days=n, hours=hour)


def frame(spark, *rows):
    return spark.createDataFrame([(i, f, t, {"n": t or ""}, at) for i, f, t, at in rows], SCHEMA)


def found(rows):
    return {(r.index_name, r.field_name, r.field_type, r.settings["n"]) for r in rows.collect()}


@pytest.fixture
def base(spark):
    return work_path(spark, "snapshots")


def test_days_come_again_and_late(spark, base):
    parts = [
        frame(spark, ("i", "f", "long", day(0)), ("i", "g", "long", day(0)), ("j", "f", "text", day(0))),
        frame(spark, ("i", "f", "text", day(3)), ("i", "h", "long", day(3)), (None, "f", None, day(3))),
        frame(spark, ("i", "f", "date", day(1)), ("i", "k", "long", day(1)), ("j", "f", "long", day(1))),
    ]
    whole = parts[0]
    snapshots.append_snapshot(parts[0], base)
    for part in parts[1:]:
        snapshots.append_snapshot(part, base)
        snapshots.append_snapshot(part, base)
        whole = whole.unionAll(part)
        assert found(snapshots.newest(spark, base)) == found(catalog.latest(whole))
    assert spark.read.parquet(f"{base}/history").count() == 9
    # day 3 again, without h and with an older type of f: the rows it had are gone, those before count again
    snapshots.append_snapshot(frame(spark, ("i", "g", "date", day(3))), base)
    assert found(snapshots.newest(spark, base)) == {
        ("i", "f", "date", "date"), ("i", "g", "date", "date"), ("i", "k", "long", "long"), ("j", "f", "long", "long"),
    }


def test_old_days_are_not_read_again(spark, base):
    for n in range(4):
        snapshots.append_snapshot(frame(spark, ("i", f"f{n}", "long", day(n))), base)
    assert all("/newest/upto=2024-01-04/" in f for f in snapshots.newest(spark, base).inputFiles())
    # as after an append that was broken off before its state was written
    folder, files = snapshots._folder(spark, f"{base}/newest/upto=2024-01-04")
    files.delete(folder, True)
    rows = snapshots.newest(spark, base)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(refreshed_on" in plan and "2024-01-03" in plan
    assert rows.count() == 4
    assert {f.split("/")[-2] for f in rows.inputFiles()} >= {"upto=2024-01-03"}


def test_ties_times_that_are_null_and_a_hot_field(spark, base):
    hot = spark.range(3000).select(
        F.lit("i").alias("index_name"), F.lit("hot").alias("field_name"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("field_type"),
        F.create_map(F.lit("n"), F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("settings"),
        F.lit(T0).alias("refreshed_at"),
    )
    odd = frame(spark, ("i", "x", "long", None), ("i", "y", "long", None), ("i", "y", "text", day(0)))
    snapshots.append_snapshot(hot.unionAll(odd), base)
    snapshots.append_snapshot(frame(spark, ("i", "x", "date", None)), base)
    # the rows without a time are a day of their own: it was replaced
    assert found(snapshots.newest(spark, base)) == {
        ("i", "hot", "b", "b"), ("i", "x", "date", "date"), ("i", "y", "text", "text"),
    }


def test_empty_snapshots_and_new_columns(spark, base):
    empty = frame(spark, ("i", "f", "long", day(0))).limit(0)
    snapshots.append_snapshot(empty, base)
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.newest(spark, base)
    snapshots.append_snapshot(frame(spark, ("i", "f", "long", day(0))), base)
    snapshots.append_snapshot(empty, base)
    wider = frame(spark, ("i", "g", "long", day(1))).withColumn("shards", F.lit(3))
    snapshots.append_snapshot(wider, base)
    got = {(r.field_name, r.shards) for r in snapshots.newest(spark, base).collect()}
    assert got == {("f", None), ("g", 3)}


def test_few_states_are_kept(spark, base):
    for n in range(3):
        snapshots.append_snapshot(frame(spark, ("i", f"f{n}", "long", day(n))), base, kept_states=1)
    assert [str(s) for s in snapshots._states(spark, base)] == ["2024-01-03"]
    snapshots.append_snapshot(frame(spark, ("i", "f0", "text", day(0))), base, kept_states=1)
    assert {r.field_type for r in snapshots.newest(spark, base).collect()} == {"text", "long"}
    assert snapshots.newest(spark, base).count() == 3
