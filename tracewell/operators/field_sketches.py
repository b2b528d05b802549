"""Distinct-value counts that are kept up to date: one sketch per index, field and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.operators.cardinality import SKETCH_BITS, field_cardinality, referenced_fields, sketched

STORED = "field_name string, sketch binary, index_name string, day date"
LIMITS = (rules.HIGH_CARDINALITY, rules.TRIGRAM_CARDINALITY)
MARGIN = 0.05  # six standard errors of a sketch of 14 bits


def day_sketches(
    table: DataFrame, index_name: str, fields: Sequence[str], day: Column, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """(index_name, field_name, day, sketch) of the given fields, from one scan.

    A sketch is at most some ``2 ** sketch_bits`` bytes and is merged before the
    shuffle, so a day with a third of all rows is no hot spot. Rows without a
    day have a null one of their own. Each day becomes a folder: for a table
    that covers many years give the first day of a month instead.
    """
    per_day = table.select(day.cast("date").alias("_day"), *(F.col(f"`{f}`") for f in fields)).groupBy("_day").agg(
        *(F.hll_sketch_agg(sketched(table, f), sketch_bits).alias(f"s{i}") for i, f in enumerate(fields))
    )
    entries = F.array(
        *(F.struct(F.lit(f).alias("field_name"), F.col(f"s{i}").alias("sketch")) for i, f in enumerate(fields))
    )
    return per_day.select("_day", F.explode(entries).alias("e")).select(
        F.lit(index_name).alias("index_name"), "e.field_name", F.col("_day").alias("day"), "e.sketch"
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Write the days that ``sketches`` holds; each replaces what was there for its index and day.

    So a day that is sketched again, with late rows or by a repeated batch,
    counts once. All fields of an index belong into one call. Starts a job.
    """
    (
        sketches.select("field_name", "sketch", "index_name", "day")
        .hint("rebalance", F.col("index_name"), F.col("day"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("index_name", "day")
        .parquet(path)
    )


def estimated_cardinality(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """(index_name, field_name, cardinality) over all written days, or those from ``since`` on."""
    sketches = spark.read.schema(STORED).parquet(path)
    if since is not None:
        sketches = sketches.where(F.col("day") >= since)
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("index_name", "field_name").agg(
        F.coalesce(merged, F.lit(0).cast("bigint")).alias("cardinality")
    )


def settled_cardinality(
    estimates: DataFrame,
    tables: Mapping[str, DataFrame],
    limits: Sequence[int] = LIMITS,
    margin: float = MARGIN,
) -> DataFrame:
    """``estimates`` with exact counts where the estimate can't tell which side of a limit it is on.

    Starts a job to find those fields (at most the columns of ``tables``); only
    they are counted, each table in one scan.
    """
    close = F.lit(False)
    for limit in limits:
        close = close | (F.abs(F.col("cardinality") - limit) <= limit * margin)
    near = estimates.where(close).select("index_name", F.col("field_name").alias("field"))
    fields = referenced_fields(near, tables)
    if not fields:
        return estimates
    exact = field_cardinality(tables, fields, exact=True).withColumnRenamed("cardinality", "exact")
    both = estimates.join(exact, ["index_name", "field_name"], "left")
    return both.select("index_name", "field_name", F.coalesce("exact", "cardinality").alias("cardinality"))
