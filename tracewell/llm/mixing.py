"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of all words. A source that would need
more than ``MAX_EPOCHS`` passes over its words is clamped there, and what it
leaves is shared by weight among the others, round by round, until no source is
above its cap. Within a source, whole passes take every document; the rest is
taken from documents in the order of a seeded digest until the words are
reached, the last one in part. A rerun takes the same words.

Cases: null text has no words; null source is a source of its own, the last;
documents without words take none; sources without words have target 0; an
empty table gives an empty result. Ties of the digest go by doc_id and size;
rows repeated in full are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.sizes import landed

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, counted from 0 in code point order, null last, without one task for all."""
    ordered = sources.orderBy(F.asc_nulls_last("source")).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("in_part")
    )
    ordered = landed(ordered.withColumn("in_part", F.expr("in_part & 8589934591")), "sources")
    counts = dict(ordered.groupBy("part").count().collect())  # one row per partition
    parts = sorted(counts)
    first = accumulate((counts[part] for part in parts[:-1]), initial=0) if parts else ()
    # from Arrow, as lists would start Python workers of another kind beside those that tasks have
    offsets = pa.table({"part": pa.array(parts, pa.int32()), "first": pa.array(first, pa.int64())})
    offsets = ordered.sparkSession.createDataFrame(offsets)
    return ordered.join(F.broadcast(offsets), "part").select(
        "source", "source_size", (F.col("first") + F.col("in_part")).alias("place")
    )


def water_fill(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size) with ``target`` words. Starts one small job per round."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = _numbered(sources).select("source", "source_size", weight.alias("weight"))
    table = landed(table.withColumn("cap", F.col("source_size") * max_epochs), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # A level of `water` words per unit of weight; what was capped once stays so.
    water = 0.0
    while True:
        above = F.lit(water) * F.col("weight") > F.col("cap")
        taken, free = table.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        level = (total - taken) / free
        if level <= water:
            break
        water = level
    target = F.when(above, F.col("cap").cast("double")).otherwise(F.lit(water) * F.col("weight"))
    return table.select("source", "source_size", F.round(target, 6).alias("target"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken. Starts jobs."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("digest"))
    rows = landed(rows.withColumn("bucket", F.substring("digest", 1, 3)), "sized")
    buckets = landed(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = landed(water_fill(sources, weights, max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    plan = plan.select("*", whole.alias("whole"), rest.alias("rest"))
    # 4,096 buckets a source: running sums over buckets first, then within the one that is cut
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    state = buckets.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    state = state.withColumnsRenamed({"source": "s", "bucket": "b"}).join(
        plan, F.col("s").eqNullSafe(F.col("source"))
    ).drop("source")
    state = landed(state, "bucket-state")
    same = rows["source"].eqNullSafe(state["s"]) & (rows["bucket"] == state["b"])
    rows = rows.join(state, same).drop("s", "b", "bucket")
    is_cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    within = (
        Window.partitionBy("source", F.substring("digest", 1, 3))
        .orderBy("digest", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = rows.where(is_cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    sure = rows.where(~is_cut).withColumn(
        "part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(F.lit(0))
    )
    return sure.unionByName(cut).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )
