"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of ``BLOCK_BYTES``. Blocks are sorted and get
integer names, equal blocks the same one. Adjacent names are then paired and
the pairs named in the same way, level by level, until a text has one name.
Equal names of one level mean equal texts: contents decide, not digests.

Cases: null text counts as empty; an empty text is one empty block, so all
empty texts are equal. A ``doc_id`` of null loses against any number. Rows that
repeat both ``doc_id`` and text share one verdict; ``deduplicated`` returns one
of them. A text of any length is cut by byte offsets. Columns other than
``doc_id`` and ``text`` pass through ``deduplicated`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.words import byte_slices
from tracewell.operators.sizes import landed, small_batches

BLOCK_BYTES = 4096
HOT_BLOCKS = 1000  # blocks compared without a shuffle: at most 4 MB of content
HOT_COUNT = 100

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normalised(column: pa.Array) -> Iterator[bytes]:
    """Null as empty, A-Z in lower case, nothing else changed."""
    for s in byte_slices(column):
        raw, bounds = _LOWER[s.data].tobytes(), s.offsets.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield raw[a:b]


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _hash(block: bytes) -> int:
    return _number(hashlib.blake2b(block, digest_size=8).digest())


def _cut(text: bytes, size: int) -> list[bytes]:
    return [text[a : a + size] for a in range(0, len(text), size)] or [b""]


HEADS = "doc_id long, raw_hash long, doc_hash long, text_sha256 string, hashes array<long>"
BLOCKS = "doc_id long, doc_hash long, n int, pos int, h long, rank int, block binary"


def _heads(size: int):
    """Per row the digests of its normalised text and of the text's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, digests, hashes = [], [], []
            for text in _normalised(batch.column("text")):
                digest = hashlib.sha256(text)
                names.append(_number(digest.digest()))
                digests.append(digest.hexdigest())
                hashes.append([_hash(block) for block in _cut(text, size)])
            columns = [pa.array(names, pa.int64()), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("raw_hash"), *columns],
                ["doc_id", "raw_hash", "doc_hash", "text_sha256", "hashes"],
            )

    return run


def _hot_contents(size: int, hot: frozenset[int]):
    """The different contents of hot blocks in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text in _normalised(batch.column("text")):
                seen.update((h, block) for block in _cut(text, size) if (h := _hash(block)) in hot)
        rows = sorted(seen)
        columns = [pa.array([h for h, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["h", "block"])

    return run


def _blocks(size: int, ranks: dict[tuple[int, bytes], int], hot: frozenset[int]):
    """One row per block: hot ones with their rank, others with their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _normalised(batch.column("text")), strict=True):
                name, blocks = _number(hashlib.sha256(text).digest()), _cut(text, size)
                for pos, block in enumerate(blocks):
                    h = _hash(block)
                    if h in hot:
                        rows.append((doc_id, name, len(blocks), pos, h, ranks[h, block], None))
                    else:
                        rows.append((doc_id, name, len(blocks), pos, h, None, block))
                if len(rows) >= 4096:
                    yield _table(rows, kinds, names)
                    rows = []
            yield _table(rows, kinds, names)

    return run


def _table(rows, kinds, names) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _named(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Replace ``cols`` by an integer ``name``: the place in the sorted distinct values."""
    values = rows.select(*cols).distinct().sortWithinPartitions(*cols)
    names = landed(values.withColumn("name", F.monotonically_increasing_id()), f"names-{label}")
    return rows.join(names, cols).drop(*cols)


def _block_ranks(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rank of a block's content among the contents that share its hash.

    A rank over 1 is a collision, told apart by content. The most frequent
    blocks are compared with a copy of their contents in every task (bounded by
    HOT_BLOCKS times BLOCK_BYTES); the others meet by hash, in groups of which
    none is as large as those.
    """
    texts = rows.select("text")
    counts = heads.select(F.explode("hashes").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "h").limit(HOT_BLOCKS)
    hot = frozenset(r.h for r in top.collect())
    ranks: dict[tuple[int, bytes], int] = {}
    if hot:
        found = texts.mapInArrow(_hot_contents(BLOCK_BYTES, hot), "h long, block binary").distinct()
        for h, block in sorted((r.h, bytes(r.block)) for r in found.collect()):
            ranks[h, block] = 1 + sum(x == h for x, _ in ranks)
    cut = rows.select("doc_id", "text").mapInArrow(_blocks(BLOCK_BYTES, ranks, hot), BLOCKS)
    keep = ["doc_id", "doc_hash", "n", "pos", "h", "rank"]
    by_content = F.dense_rank().over(Window.partitionBy("h").orderBy("block"))
    seldom = cut.where("rank is null").withColumn("rank", by_content)
    return cut.where("rank is not null").select(*keep).unionByName(seldom.select(*keep))


def text_names(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """One (level, name) per distinct (doc_id, doc_hash); equal exactly for equal texts.

    Starts a few jobs per level; a text of n blocks takes log2(n) levels.
    """
    ranks = landed(_block_ranks(rows, heads), "block-ranks")  # contents are shuffled once
    now = landed(_named(ranks, ["h", "rank"], "0"), "level-0")
    key, level, done = ["doc_id", "doc_hash"], 0, []
    longest = now.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(now.where("n = 1").select(*key, F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        level, longest = level + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = (
            now.where("n > 1")
            .groupBy(*key, ((F.col("n") + 1) / 2).cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("left_name"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right_name"),
            )
        )
        now = landed(_named(pairs, ["left_name", "right_name"], str(level)), f"level-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, doc_hash, raw_hash.

    Of equal texts the row with the largest ``doc_id`` stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _raw_hash().alias("raw_hash"))
    with small_batches(docs.sparkSession):
        heads = landed(rows.mapInArrow(_heads(BLOCK_BYTES), HEADS), "heads")
        ids = landed(text_names(rows, heads).withColumnsRenamed({"doc_id": "d", "doc_hash": "x"}), "text-names")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_hash") == F.col("x"))
    named = landed(heads.drop("hashes").join(ids, same).drop("d", "x"), "named-rows")
    groups = named.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # most texts occur once: only the groups of several are joined back
    several = landed(groups.where("group_size > 1"), "groups")
    out = named.join(several, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "doc_hash",
        "raw_hash",
    )


def _raw_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text occurs under a larger ``doc_id``."""
    found = exact_duplicates(docs).where("kept").groupBy("doc_id", "doc_hash", "raw_hash").count()
    # rows of one doc_id that differ in case only are one text too
    kept = found.groupBy("doc_id", "doc_hash").agg(F.max(F.struct("raw_hash", "count")).alias("one"))
    kept = kept.select(F.col("doc_id").alias("__id"), "one.*").withColumnRenamed("raw_hash", "__hash")
    kept = landed(kept.withColumnRenamed("count", "__copies"), "kept")
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (_raw_hash() == kept["__hash"])
    rows = docs.join(kept, same).drop("__id")
    once = rows.where("__copies = 1").drop("__hash", "__copies")
    if kept.where("__copies > 1").isEmpty():
        return once
    again = rows.where("__copies > 1").dropDuplicates(["doc_id", "__hash"]).drop("__hash", "__copies")
    return once.unionByName(again)
