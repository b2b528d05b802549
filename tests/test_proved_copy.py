"""A copy is shown under the alias only if it holds what its source gives."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rewrite
from tracewell.plans import cycle
from tracewell.session import work_path


def mark(rows):
    return tuple(rewrite.fingerprint(rows).head())


def test_fingerprint(spark):
    schema = "id int, t string, x double"
    rows = [(1, "a", 1.5), (2, None, None), (2, None, None), (None, "", float("nan")), (3, "a", -0.0)]
    whole = spark.createDataFrame(rows, schema)
    assert mark(whole) == mark(spark.createDataFrame(rows[::-1], schema).repartition(3))
    others = [
        rows[:-1], rows + rows[:1], rows[:1] + rows[3:], rows[:1] + rows[3:] + rows[:1] * 2,
        [*rows[:3], (None, None, float("nan")), rows[4]], [(1, "a", None), (2, None, 1.5), *rows[2:]],
    ]
    marks = {mark(spark.createDataFrame(r, schema)) for r in others} | {mark(whole)}
    assert len(marks) == len(others) + 1
    # a pair of equal rows in place of another pair: the xor alone would not see it
    a, b, c = (1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)
    assert mark(spark.createDataFrame([a, b, b], schema)) != mark(spark.createDataFrame([a, c, c], schema))
    # null and value swapped between two columns of one type
    two = "a string, b string"
    assert mark(spark.createDataFrame([("x", None)], two)) != mark(spark.createDataFrame([(None, "x")], two))
    assert mark(spark.createDataFrame([], schema)) == (0, 0, 0)


def test_fingerprint_of_nested_columns(spark):
    row = "SELECT named_struct('m', map('a', array(1, 2), 'b', array())) AS s, array(map(1, 'x')) AS l, map() AS e"
    turned = row.replace("'a', array(1, 2), 'b', array()", "'b', array(), 'a', array(1, 2)")
    assert mark(spark.sql(row)) == mark(spark.sql(turned))
    assert mark(spark.sql(row)) != mark(spark.sql(row.replace("array(1, 2)", "array(2, 1)")))
    named = spark.range(2).select(F.col("id").alias("a.b"), F.col("id").alias("c d"))
    assert mark(named)[0] == 2


@pytest.fixture
def names(spark):
    used = ["proved_one", "proved_two"]
    drop = lambda: [spark.sql("DROP VIEW IF EXISTS proved")] + [
        spark.sql(f"DROP TABLE IF EXISTS {n}") for n in used
    ]
    drop()
    yield used
    drop()


def test_empty_and_hot_partitions(spark, names):
    empty = spark.createDataFrame([], "id int, p string")
    assert cycle.rewrite_table(empty, names[0], "proved", {"id": "string"}, path=work_path(spark, "p")) == 0
    hot = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "h").otherwise(F.col("id").cast("string")[0:1]).alias("p"))
    with_null = hot.withColumn("p", F.when(F.col("id") != 5, F.col("p")))
    written = cycle.rewrite_table(
        with_null, names[1], "proved", {"id": "int"}, None, ("p",), path=work_path(spark, "p")
    )
    assert written == 900 == spark.table("proved").count()
    assert spark.table("proved").where("p is null").head().id == 5


def test_a_copy_that_lost_something_is_not_shown(spark, names):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    cycle.rewrite_table(good, names[0], "proved", {}, path=work_path(spark, "p"))
    # partition folders can't tell an empty value from none
    blank = good.unionAll(spark.createDataFrame([(3, "")], "id int, p string"))
    with pytest.raises(rewrite.CopyMismatch, match="copied 3 rows of 3"):
        cycle.rewrite_table(blank, names[1], "proved", {}, None, ("p",), path=work_path(spark, "p"))
    assert spark.table("proved").count() == 2
    assert not spark.catalog.tableExists(names[1])
    # the name is free again
    assert cycle.rewrite_table(blank, names[1], "proved", {}, path=work_path(spark, "p")) == 3


def test_missing_rows_and_other_columns(spark, names):
    source = spark.range(100)
    rewrite.write_rewritten(source.where("id <> 7"), names[0], path=work_path(spark, "p"))
    with pytest.raises(rewrite.CopyMismatch, match="99 rows of 100"):
        rewrite.prove_copy(source, names[0])
    with pytest.raises(rewrite.CopyMismatch, match="columns"):
        rewrite.prove_copy(source.select(F.col("id").cast("int")), names[0])
    assert rewrite.prove_copy(source.where("id <> 7"), names[0]) == 99
