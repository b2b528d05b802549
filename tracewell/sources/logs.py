"""Readers for logs, metrics and the field catalogue."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import rules, schemas
from tracewell.functions.text import glob_to_like


def read_slowlog(spark: SparkSession, path_glob: str) -> DataFrame:
    """Every Parquet log file under a path glob, with the fixed schema."""
    return spark.read.schema(schemas.SLOWLOG).parquet(path_glob)


def read_node_metrics(spark: SparkSession, path_glob: str) -> DataFrame:
    return spark.read.schema(schemas.NODE_METRICS).parquet(path_glob)


METRIC_LEAVES = {
    "cpu_pct": "os.cpu.percent",
    "mem_used_pct": "os.mem.used_percent",
    "disk_read_kb": "fs.io_stats.total.read_kilobytes",
    "disk_write_kb": "fs.io_stats.total.write_kilobytes",
    "breaker_used_bytes": "breakers.parent.estimated_size_in_bytes",
    "breaker_limit_bytes": "breakers.parent.limit_size_in_bytes",
}


def flatten_node_metrics(raw: DataFrame) -> DataFrame:
    """Nested metric documents to one flat row each; only these leaves are scanned."""
    return raw.select(
        F.col("`@timestamp`").cast("timestamp").alias("ts"),
        F.col("elasticsearch.node.name").alias("node"),
        *(
            F.col(f"elasticsearch.node.stats.{leaf}").cast("double").alias(name)
            for name, leaf in METRIC_LEAVES.items()
        ),
    )


def read_tables_like(spark: SparkSession, glob: str, database: str = "default") -> DataFrame:
    """Bag union of every catalogue table whose name matches a glob; missing columns are null."""
    names = [
        row.tableName
        for row in spark.sql(f"SHOW TABLES IN {database}")
        .where(F.col("tableName").like(glob_to_like(glob)) & ~F.col("isTemporary"))
        .orderBy("tableName")
        .collect()
    ]
    if not names:
        raise FileNotFoundError(f"no table in {database} matches {glob!r}")
    tables = (spark.table(f"{database}.`{name}`") for name in names)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_field_catalog(spark: SparkSession, table: str = "field_catalog") -> DataFrame:
    return spark.table(table)


def source_coverage(required: Iterable[str], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per required source: is it there, how many rows, from when to when.

    ``tables`` maps a source name to a DataFrame with a ``ts`` column. A name
    without a table, or with an empty one, is reported as not present.
    """
    required = list(required)
    reports = []
    for name in required:
        if name not in tables:
            continue
        seen = tables[name].agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("ts").alias("earliest_ts"),
            F.max("ts").alias("latest_ts"),
        )
        reports.append(seen.select(F.lit(name).alias("source"), "*"))
    spark = next((t.sparkSession for t in tables.values()), None) or SparkSession.getActiveSession()
    wanted = spark.createDataFrame([(name,) for name in required], "source string")
    none = spark.createDataFrame(
        [], "source string, row_count bigint, earliest_ts timestamp, latest_ts timestamp"
    )
    found = reduce(DataFrame.unionByName, reports) if reports else none
    return wanted.join(found, "source", "left").select(
        "source",
        (F.coalesce("row_count", F.lit(0)) > 0).alias("present"),
        F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        "earliest_ts",
        "latest_ts",
    )


REQUIRED_SOURCES = (rules.SLOWLOG_PATTERN, rules.NODE_METRICS_PATTERN, rules.CATALOG_NAME)
