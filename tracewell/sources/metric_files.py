"""Node metric documents as JSON files, a file or folder per day, whose schema changes from day to day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewell.sources.logs import METRIC_LEAVES

CORRUPT = "_corrupt"
UNREADABLE, NO_TIME, NO_NODE = "unreadable", "no time", "no node"


def _document() -> StructType:
    """The leaves that are read, each as text: days differ in how they write a number."""
    tree: dict = {"@timestamp": {}, "elasticsearch": {"node": {"name": {}}}, CORRUPT: {}}
    for leaf in METRIC_LEAVES.values():
        level = tree["elasticsearch"]["node"].setdefault("stats", {})
        for step in leaf.split("."):
            level = level.setdefault(step, {})

    def kind(level: dict):
        fields = [StructField(name, kind(below)) for name, below in level.items()]
        return StructType(fields) if fields else StringType()

    return kind(tree)


def _number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _time(text: Column) -> Column:
    """ISO 8601, or milliseconds since 1970."""
    millis = text.try_cast("bigint")
    in_range = F.abs(millis) < 10**15  # beyond that no timestamp can be made
    return F.when(in_range, F.timestamp_millis(millis)).when(millis.isNull(), text.try_cast("timestamp"))


def read_metric_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """One flat row per document: the columns of node metrics, ``file``, ``reject`` and ``line``.

    Every file under the glob is read as lines, and of each line only the leaves
    above: what a day lacks is null, what it has besides is not parsed. Numbers
    may be written as text, times as ISO 8601 or as milliseconds; what is neither
    is null, and so is a number that is not finite. Blank lines are no documents.

    ``reject`` says why a document can't be used: it is no JSON object of this
    shape, or lacks a time or a node. Such a row keeps its ``line``, others don't;
    an unreadable one has no values, even where its beginning could be read.
    One scan, no shuffle; a broken document loses no other.
    """
    lines = spark.read.text(path_glob).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.where(F.rlike("value", F.lit(r"\S")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("doc", F.from_json("value", _document(), options))
    # what could be read of a broken document is not used
    parsed = parsed.withColumn("doc", F.when(F.col(f"doc.{CORRUPT}").isNull(), F.col("doc")))
    node = F.col("doc.elasticsearch.node")
    rows = parsed.select(
        _time(F.col("doc.`@timestamp`")).alias("ts"),
        F.nullif(F.trim(node["name"]), F.lit("")).alias("node"),
        *(_number(F.col(f"doc.elasticsearch.node.stats.{leaf}")).alias(name) for name, leaf in METRIC_LEAVES.items()),
        "file",
        F.col("doc").isNull().alias("broken"),
        "value",
    )
    reject = F.when(F.col("broken"), UNREADABLE).when(F.col("ts").isNull(), NO_TIME).when(F.col("node").isNull(), NO_NODE)
    rows = rows.withColumn("reject", reject).withColumn("line", F.when(F.col("reject").isNotNull(), F.col("value")))
    return rows.drop("broken", "value")


def usable(rows: DataFrame) -> DataFrame:
    """The node metrics among what ``read_metric_files`` gave."""
    return rows.where("reject is null").select("ts", "node", *METRIC_LEAVES)


def rejected(rows: DataFrame) -> DataFrame:
    """(file, documents, unreadable, no_time, no_node): what each file held and lost. One row per file."""
    counts = {name.replace(" ", "_"): F.count_if(F.col("reject") == name) for name in (UNREADABLE, NO_TIME, NO_NODE)}
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("documents"), *(F.coalesce(c, F.lit(0)).alias(name) for name, c in counts.items())
    )
