"""A Merkle manifest of a table: one root, a proof per row, and rows checked against it.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, in order
of doc_id, are the bottom level of the source's tree; runs of ``FANOUT`` nodes
make a parent. The subroots of all sources, in order, are the bottom of one more
tree, whose top is the root.

A level is one table of nodes (group, idx, hash). Nodes find their siblings by
equijoins on computed indices: ``idx XOR 1`` in a binary tree, else one join per
slot offset, round the run. What a node has to its left and right is its step of
every proof below it, and nodes in slot zero emit the parents. All sources climb
at once; a group that is down to one node waits. Proofs are then put together
from the root down, three children to a parent, so no key is ever hot. The
number of levels grows with the logarithm of the largest source.

Leaves are numbered by a range sort and the sizes of its parts, so no source is
gathered in one task either.

Cases: null fields count as ``-``; null source comes first; null doc_id comes
first in its source and is never tampered with; equal doc_ids go by leaf, and
rows repeated in full have equal leaves, each with a place and proof of its own;
a lone leaf is its source's subroot and a lone subroot the root, with an empty
proof; an empty table gives an empty result and no root; texts of any length are
hashed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ranking import numbered_rows
from tracewell.operators.sizes import landed

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1 << 20  # rows of a source that share a key when rows meet their source's start
STEPS = 8  # levels of proofs that are put together in one job


def _hash(*parts: Column) -> Column:
    """SHA-256 of digests (binary) as hex text, put end to end; missing ones left out."""
    hexes = [F.coalesce(F.lower(F.hex(x)), F.lit("")) for x in parts]
    return F.unhex(F.sha2(F.concat(*hexes), 256))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes."""
    texts = [x.cast("string") for x in fields]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def siblings(slot: Column, idx: Column, fanout: int) -> list[Column]:
    """Indices of the other nodes of a run, some of which may lie beyond the last node."""
    if fanout == 2:
        return [idx.bitwiseXOR(F.lit(1))]
    return [idx - slot + (slot + k) % fanout for k in range(1, fanout)]


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """Add to nodes (g, idx, size, h, ...) their slot and what stands left and right of them."""
    slot = F.col("idx") % fanout
    now = nodes.withColumn("slot", slot)
    others = nodes.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), F.col("h").alias("_h"))
    for k, at in enumerate(siblings(slot, F.col("idx"), fanout)):
        # a group of one node is done: nothing stands at its sibling's place
        own = others.withColumnRenamed("_h", f"_h{k}")
        now = now.join(own, (F.col("g") == F.col("_g")) & (at == F.col("_idx")), "left").drop("_g", "_idx")
    # the k-th sibling stands k + 1 slots on, round the run
    # the k-th sibling stands k + 1 slots on, round the run
    around = F.array(*(F.col(f"_h{k}") for k in range(fanout - 1)))
    nothing = F.lit(b"")

    def side(beyond):
        """Digests of the run's slots that lie ``beyond`` this node, put end to end."""
        at = [F.get(around, ((t - F.col("slot") + fanout) % fanout - 1).cast("int")) for t in map(F.lit, range(fanout))]
        return F.concat(*(F.when(beyond(t), F.coalesce(x, nothing)).otherwise(nothing) for t, x in enumerate(at)))

    left, right = side(lambda t: F.col("slot") > t), side(lambda t: F.col("slot") < t)
    return now.select(*nodes.columns, "slot", left.alias("left"), right.alias("right"))


def _tree(nodes: DataFrame, most: int, fanout: int, name: str) -> list[DataFrame]:
    """Levels from the bottom up, each written. ``most`` is the size of the largest group."""
    levels = []
    while True:
        levels.append(landed(_level(nodes, fanout), name))
        if most <= 1:
            return levels
        parents = levels[-1].where("slot = 0 and size > 1")
        nodes = parents.select(
            "g",
            F.expr(f"idx div {fanout}").alias("idx"),
            F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
            _hash(F.col("h"), F.col("right")).alias("h"),
        )
        most = -(-most // fanout)


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """The bottom level with ``path``, the steps up to what ``tops`` (g, subroot, path) has at its top."""
    step = F.struct("left", "right")
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].drop("h") if k else levels[k]
        up = level.where("size = 1").join(tops.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).drop("_g")
        if above is not None:
            parent = above.select(
                F.col("g").alias("_g"), F.col("idx").alias("_idx"), "subroot", F.col("path").alias("_path")
            )
            same = (F.col("g") == F.col("_g")) & (F.expr(f"idx div {fanout}") == F.col("_idx"))
            inner = level.where("size > 1").join(parent, same)
            inner = inner.withColumn("path", F.concat(F.array(step), F.col("_path"))).drop("_g", "_idx", "_path")
            up = up.unionByName(inner)
        above = up
        if k and k % STEPS == 0:
            above = landed(above, name)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda h, step: _hash(step["left"], h, step["right"]))


def proof_bytes(path: Column) -> Column:
    """The siblings of a proof, bottom up, left to right."""
    return F.aggregate(path, F.lit(b""), lambda a, step: F.concat(a, step["left"], step["right"]))


def manifest(docs: DataFrame, claimed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path, claimed_leaf (digests are binary). Starts jobs.

    ``path`` holds a step per level, bottom up: the digests left and right of the
    row's node. ``claimed`` is a text that is said to be the row's; the leaf that
    it makes is ``claimed_leaf``, to be folded with ``path``.
    """

    def leaf(text):
        return leaf_hash([text if c == "text" else F.col(c) for c in FIELDS])

    own = F.col("text")
    rows = docs.select(
        "doc_id", "source", leaf(own).alias("h"), leaf(own if claimed is None else claimed).alias("claimed_leaf")
    )
    order = (F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "h", "claimed_leaf")
    rows = landed(numbered_rows(landed(rows, "leaves"), *order), "numbered-leaves")
    groups = rows.groupBy("source").agg(F.min("position").alias("g"), F.count(F.lit(1)).alias("size"))
    groups = landed(groups, "sources")
    largest, n_groups = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    # a source meets its rows once per block of places, so that no key has more than a block
    blocks = F.sequence(F.expr(f"g div {BLOCK}"), F.expr(f"(g + size - 1) div {BLOCK}"))
    starts = groups.select(F.col("source").alias("_source"), "g", "size", F.explode(blocks).alias("_block"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.expr(f"position div {BLOCK}") == F.col("_block"))
    leaves = rows.join(starts, same)
    leaves = leaves.select("g", F.expr("position - g").alias("idx"), "size", "h", "doc_id", "claimed_leaf")
    levels = _tree(leaves, largest or 0, fanout, "merkle-level")

    # subroots are what groups of one node hold, at whichever level they came to that
    subroots = levels[0].where("size = 1").select("g", "h")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("size = 1").select("g", "h"))
    subroots = numbered_rows(subroots.withColumnRenamed("g", "source_g"), "source_g")
    zero = F.lit(0).cast("long")
    subroots = subroots.select(
        zero.alias("g"), F.expr("position - 1").alias("idx"), F.lit(n_groups).cast("long").alias("size"), "h", "source_g"
    )
    top = _tree(subroots, n_groups, fanout, "merkle-top")
    root = top[-1].select("h").head(1)  # one node
    root = F.lit(bytes(root[0][0])) if root else F.lit(None).cast("binary")

    end = docs.sparkSession.createDataFrame(
        [(0, bytearray(), [])], "g long, subroot binary, path array<struct<left binary, right binary>>"
    )
    over = _paths(top, end, fanout, "merkle-top-paths")
    over = landed(over.select(F.col("source_g").alias("g"), F.col("h").alias("subroot"), "path"), "subroot-paths")
    out = _paths(levels, over, fanout, "merkle-paths")
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), "path", "claimed_leaf")
