"""Latency statistics and before/after comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.operators.ranking import nearest_rank


def latency_stats(
    runs: DataFrame, keys: Sequence[str] = ("query", "variant"), exact_p95: bool = True
) -> DataFrame:
    """min, max, mean, nearest-rank p95 and count of ``elapsed_ms`` per group.

    The p95 is element ``floor(0.95 n)`` counted from 0, so with ten runs it is
    the slowest. ``exact_p95=False`` takes the sketch alone: one pass, no join.
    """
    keys = list(keys)
    if exact_p95:
        stats = nearest_rank(runs, keys, "elapsed_ms", rules.P95)
        return stats.select(
            *keys,
            F.col("least").alias("min_ms"),
            F.col("most").alias("max_ms"),
            (F.col("total") / F.col("rows")).alias("avg_ms"),
            F.col("ranked").alias("p95_ms"),
            F.col("rows").alias("iterations"),
        )
    return runs.groupBy(*keys).agg(
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.avg("elapsed_ms").alias("avg_ms"),
        F.percentile_approx("elapsed_ms", rules.P95).alias("p95_ms"),
        F.count("elapsed_ms").alias("iterations"),
    )


def latency_compare(
    runs: DataFrame,
    query: str = "query",
    baseline: str = "baseline",
    optimized: str = "optimized",
) -> DataFrame:
    """Improvement of one variant over the other, per query.

    A zero or missing baseline gives 0.0 and no confirmation. Both means come
    from one grouping, so the two sides are never joined.
    """
    def mean(variant: str):
        return F.avg(F.when(F.col("variant") == variant, F.col("elapsed_ms")))

    means = runs.groupBy(query).agg(
        mean(baseline).alias("baseline_avg_ms"), mean(optimized).alias("optimized_avg_ms")
    )
    gain = (F.col("baseline_avg_ms") - F.col("optimized_avg_ms")) / F.col("baseline_avg_ms") * 100
    usable = (F.col("baseline_avg_ms") > 0) & F.col("optimized_avg_ms").isNotNull()
    return means.select(
        query,
        "baseline_avg_ms",
        "optimized_avg_ms",
        F.when(usable, F.round(gain, 2)).otherwise(F.lit(0.0)).alias("improvement_pct"),
        F.when(usable, gain > 0).otherwise(F.lit(False)).alias("improvement_confirmed"),
    )
