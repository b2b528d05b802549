"""Connected components of an edge list, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sizes import dropped, landed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Alternates large-star and small-star steps until the edges stand still: each
    step points neighbours at a smaller node, so the number of edges never grows
    and rounds grow with the logarithm of the longest chain. Smallest neighbours
    are found by aggregates, so that a node with very many neighbours is split.
    Starts two jobs a round. Loops and repeated edges are allowed.
    """
    now = landed(_ordered(edges.select("a", "b")), "edges")
    print_now = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # large star: neighbours above a node point to the smallest around it
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = _ordered(large)
        # small star: neighbours below a node, and the node, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "least")
        small = small.select(F.explode(F.array("x", "a")).alias("a"), F.col("least").alias("b"))
        after = landed(_ordered(small), "edges")
        print_after = _print(after)
        dropped(now)
        if print_after == print_now:
            now = after
            break
        now, print_now = after, print_after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first; no loops."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _print(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
