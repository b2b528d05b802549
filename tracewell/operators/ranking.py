"""Exact order statistics that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sizes import landed

STEPS = 64  # buckets per doubling of a value
PARTS = 4096  # a crowded bucket is divided again into so many
CROWDED = 100_000  # distinct values that one task puts in order

MAX_TOP_ROWS = 100_000
SLOT_ROWS = 50_000


def magnitude(value: Column) -> Column:
    """A whole number that never falls as a double rises: one of STEPS buckets per doubling.

    Needs no look at the data first. NaN comes last, as in Spark's order.
    """
    lowest = 1075 * STEPS  # the least double is 2 ** -1074
    size = F.abs(value)
    # an infinite size has no whole logarithm
    steps = F.when(size < float("inf"), F.floor(F.log2(size) * STEPS) + lowest).otherwise(3000 * STEPS)
    place = F.when(value > 0, steps).when(value < 0, -steps).otherwise(0)
    return F.when(F.isnan(value), 3001 * STEPS).otherwise(place).cast("int")


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Exact element ``floor(n * share)`` (0-based) of each group's sorted values.

    Gives ``keys``, ``ranked`` and, of the values, ``rows``, ``total``, ``least`` and
    ``most``. Two scans. The first counts values by order of magnitude, before the
    shuffle; running sums show which bucket of a group holds the rank, and sums
    over its buckets give the rest. The second lands the distinct values of that
    bucket with their counts, unless it holds a single value. Only a bucket with
    more than CROWDED distinct values is divided further, on what was landed.
    Counts are exact, so no rank is missed, and no task gets more of a group than
    its buckets or CROWDED values. A null key is a group like any other; null
    values are left out, NaN counts as the largest value. Starts jobs.
    """
    keys = list(keys)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = rows.withColumn("_bucket", magnitude(F.col("_v")))
    counted = rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_t"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    group = Window.partitionBy(*keys)
    counted = counted.withColumns(
        {
            "_before": F.sum("_c").over(group.orderBy("_bucket")) - F.col("_c"),
            "rows": F.sum("_c").over(group),
            "total": F.sum("_t").over(group),
            "least": F.min("_low").over(group),
            "most": F.max("_high").over(group),
        }
    )
    rank = F.least(F.floor(F.col("rows") * share), F.col("rows") - 1)
    kept = [*keys, "rows", "total", "least", "most"]
    groups = counted.withColumn("_rank", rank - F.col("_before")).where("_rank >= 0 and _rank < _c")
    groups = landed(groups.select(*kept, "_bucket", "_low", "_high", "_rank"), "rank-groups")
    open_groups = groups.where("_low < _high").select(*keys, "_bucket", "_low", "_high", "_rank")
    # a hot group is spread over its buckets, and meets its rank in one of them
    values = _joined(rows, open_groups.select(*keys, "_bucket"), [*keys, "_bucket"])
    values = landed(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "rank-values")
    while True:
        # values that a group's last division left out stand outside its bounds
        inside = _joined(values, open_groups.drop("_bucket"), keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        crowd = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n")).head().n
        if (crowd or 0) <= CROWDED:
            break
        place = F.when(F.col("_v") == F.col("_low"), 0).otherwise(F.width_bucket("_v", "_low", "_high", F.lit(PARTS)))
        parts = inside.groupBy(*keys, "_rank", place.alias("_bucket")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        before = F.sum("_c").over(group.orderBy("_bucket")) - F.col("_c")
        parts = parts.withColumn("_rank", F.col("_rank") - before).where("_rank >= 0 and _rank < _c")
        open_groups = landed(parts.select(*keys, "_bucket", "_low", "_high", "_rank"), "rank-parts")
    up_to = F.sum("_c").over(group.orderBy("_v"))
    found = inside.withColumn("_up_to", up_to).where("_up_to > _rank and _up_to - _c <= _rank")
    found = found.select(*keys, F.col("_v").alias("ranked"))
    single = groups.where("not _low < _high").select(*kept, F.col("_low").alias("ranked"))
    return single.unionByName(_joined(groups.where("_low < _high").select(*kept), found, keys))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one group: one row
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(right, same).drop(*(f"_key_{k}" for k in keys))


def numbered_rows(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Number rows from 1 in a total order without one task for all of them. Starts jobs.

    Rows are range-sorted and written with their place within the part; the sizes
    of the parts, one small row each, make that a place among all.
    """
    placed = rows.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part"),
    )
    placed = landed(placed, "numbered")
    counts = dict(placed.groupBy("_part").count().collect())
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    place = (F.col("_before") + F.col("_in_part") + 1).alias(name)
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, place)


def first_rows(
    rows: DataFrame, major: str, minor: str, n: int, max_top: int = MAX_TOP_ROWS
) -> DataFrame:
    """The first ``n`` rows by two whole-number columns that no two rows share.

    Up to ``max_top`` rows come from a top-n, where each task keeps n. Beyond
    that rows are counted per slot of ``minor``; slots before the cut are kept
    whole and only the rows of the slot at the cut are sorted. That starts a job.
    """
    if n <= max_top:
        return rows.orderBy(major, minor).limit(n)
    slot = F.floor(F.col(minor) / SLOT_ROWS)
    slots = rows.groupBy(F.col(major).alias("major"), slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("here")
    )
    # one row per SLOT_ROWS rows of input
    upto = F.sum("here").over(Window.orderBy("major", "slot"))
    cut = slots.withColumn("upto", upto).where(F.col("upto") > n).orderBy("upto").head()
    if cut is None:
        return rows
    same = F.col(major) == cut.major
    before = rows.where((F.col(major) < cut.major) | (same & (slot < cut.slot)))
    at = rows.where(same & (slot == cut.slot)).orderBy(minor).limit(n - (cut.upto - cut.here))
    return before.unionAll(at)
