"""N-gram Jaccard join by a size-aware split into light and heavy sets.

A document's set holds its distinct ``WIDTH``-word shingles, as 64-bit hashes.
Documents with equal sets form a class, and classes are joined:

* Light sets (at most ``boundary`` shingles) enumerate, for every size a partner
  may have, their subsets of exactly the overlap that the threshold asks for. A
  shared subset is a link.
* Heavy sets scan inverted lists. The lists hold, in one order of all shingles
  with frequent ones last, only as many first shingles of a set as it takes for
  two similar sets to share one. Light sets that may meet heavy ones are listed
  too.

The boundary is the one of least cost: subsets to enumerate against list entries
to scan, from the sizes and the frequencies of all documents.

No list is turned into all its pairs. First every set is paired with the one
set that leads most of its lists; checked pairs give components. Then lists that
still span several components are joined across components only: what is not in
a list's main component meets the others. Pairs that share too few listed
shingles to reach the threshold are dropped, the rest is checked on whole sets.
So every pair is checked or already connected, and components are exact.

Cases: null and empty texts have the empty set and link with nothing, not even
each other; fewer than WIDTH words make one shingle; repeated rows and equal
texts are one class; rows of one doc_id with different sets are documents of their
own; a document without doc_id links and connects like any other but cannot be a
component's name, so a component of such documents only has none (null); doc_ids
are below 3 * 2 ** 61; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.graph import components
from tracewell.llm.words import WordSlices, mixed, unique
from tracewell.operators.sizes import broadcast_if_small, dropped, landed, shuffles_freed, small_batches

WIDTH = 5
NUM, DEN = 3, 4  # similarity at least NUM / DEN
FREQUENT = 400_000  # shingles ordered by frequency: a table of 5 MB in every task
LIGHT_MOST = 24  # sizes for which subsets are counted at all; more would cost more than any list
NAMELESS = 3 << 61  # from here on stand the numbers of documents without doc_id
TEXTS_IN_PLACE = 400_000  # classes, three numbers each, that are sent to the texts rather than meet them in a shuffle
CLASS = 6 / 5  # sizes within this ratio are one class
ENTRIES = 2_000_000  # list entries brought together in one task
SLICE = 1 << 18  # bytes of text that a task works on at once


def overlap(n, m):
    """The least intersection of sets of n and m shingles that reaches the threshold."""
    return -(-NUM * (n + m) // (NUM + DEN))


def listed(n):
    """How many first shingles of a set of n are listed."""
    return n - -(-NUM * n // DEN) + 1


def partner_sizes(n: int, most: int) -> range:
    return range(-(-NUM * n // DEN), min(most, DEN * n // NUM) + 1)


def subsets(n: int, most: int) -> int:
    """How many subsets a light set of n enumerates."""
    return sum(comb(n, overlap(n, m)) for m in partner_sizes(n, most))


@dataclass(frozen=True)
class Plan:
    """What tasks need to know: shingles known to be frequent, rarest first, and the boundary."""

    frequent: np.ndarray  # sorted hashes
    rank: np.ndarray
    boundary: int

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A number per shingle that gives the order of lists: frequent ones last."""
        key = shingles >> np.uint64(1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
            often = self.frequent[at] == shingles
            key[often] = self.rank[at[often]] | np.uint64(1 << 63)
        return key


def _two(x: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set of hashes, whatever their order."""
    other = mixed(x ^ np.uint64(0xA0761D6478BD642F))
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def _class(n: int, one: int, two: int) -> int:
    """The number of the class of equal sets."""
    with np.errstate(over="ignore"):
        x = mixed(np.array([one, two, n], np.int64).view(np.uint64) * np.array([1, 3, 5], np.uint64))
        return int(mixed(x.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and class; per task the shingles it has in two sets or more."""
    cut, seen, held, size = WordSlices(most=SLICE), set(), [], 0

    def often():
        x = np.concatenate(held) if held else np.empty(0, np.uint64)
        held.clear()
        x.sort()
        h, n = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)
        nothing, zero = pa.nulls(len(h), pa.int64()), np.zeros(len(h), np.int64)
        return batch_of(nothing, nothing, n + 1, h.view(np.int64), zero, np.ones(len(h), bool))

    def batch_of(ids, text_hash, n, one, two, frequent):
        numbers = [pa.array(x, pa.int64()) for x in (n, one, two)]
        return pa.RecordBatch.from_arrays(
            [ids, text_hash, *numbers, pa.array(frequent)], ["doc_id", "text_hash", "n", "one", "two", "frequent"]
        )

    for batch in batches:
        n, one, two = [], [], []
        for s in cut.slices(batch.column("text")):
            for x in s.shingle_sets(WIDTH):
                a, b = _two(x) if len(x) else (0, 0)
                n.append(len(x))
                one.append(a)
                two.append(b)
                if len(x) and (a, b) not in seen:
                    seen.add((a, b))
                    held.append(x)
                    size += len(x)
            if size > 2_500_000:
                yield often()
                size, seen = 0, set()
        yield batch_of(batch.column("doc_id"), batch.column("text_hash"), n, one, two, np.zeros(len(n), bool))
        pa.default_memory_pool().release_unused()  # workers wait for their next task with what they hold
    yield often()


def _entries(plan: Plan, ranges: int):
    """List entries and subsets of each class in a task, dealt into ranges of keys.

    A row holds the entries of one range as packed numbers: key, class, size,
    place in the set's order.
    Entries of frequent shingles, which surely have company, come as rows of
    their own (range -1), since their lists may be of any length.
    """

    names = ("key", "sid", "n", "place")

    def flush(keys, sids, sizes):
        counts = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        sid = np.repeat(np.array(sids, np.int64), counts)
        n = np.repeat(np.array(sizes, np.int32), counts)
        rank = (np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        hot = key >= np.uint64(1 << 63)
        place = (mixed(key) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        order = order[~hot[order]]
        edges = np.searchsorted(place[order], np.arange(ranges + 1))
        held = np.flatnonzero(np.diff(edges)).tolist()
        parts = [order[edges[r] : edges[r + 1]] for r in held]
        often = [x for x in np.array_split(np.flatnonzero(hot), max(1, hot.sum() // 100_000)) if len(x)]
        r = pa.array(held + [-1] * len(often), pa.int32())
        packed = [
            pa.array([x[part].tobytes() for part in parts + often], pa.binary()) for x in (key, sid, n, rank)
        ]
        return pa.RecordBatch.from_arrays([r, *packed], ["r", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen, keys, sids, sizes, size = WordSlices(most=SLICE), set(), [], [], [], 0
        for batch in batches:
            for s in cut.slices(batch.column("text")):
                for x in s.shingle_sets(WIDTH):
                    n = len(x)
                    if not n:
                        continue
                    name = _class(n, *_two(x))
                    if name in seen:
                        continue
                    seen.add(name)
                    key = np.empty(0, np.uint64)
                    if DEN * n > NUM * plan.boundary:
                        k, take = plan.keys(x), listed(n)
                        k = np.partition(k, take - 1)[:take] if take < n else k
                        key = np.sort(k) & ~np.uint64(1)
                    if n <= plan.boundary:
                        key = np.concatenate((key, _subset_keys(x, plan.boundary)))
                    keys.append(key)
                    sids.append(name)
                    sizes.append(n)
                    size += len(key)
                if size > 500_000:
                    yield flush(keys, sids, sizes)
                    keys, sids, sizes, size = [], [], [], 0
                if len(seen) > 100_000:
                    seen = set()
            pa.default_memory_pool().release_unused()
        if keys:
            yield flush(keys, sids, sizes)

    return run


def _subset_keys(x: np.ndarray, most: int) -> np.ndarray:
    """One odd number per subset that the set shares with a similar light set of some size."""
    n, out = len(x), []
    for m in partner_sizes(n, most):
        kind = mixed(np.array([min(n, m) * 1000 + max(n, m)], np.uint64))
        picks = np.array(list(combinations(range(n), overlap(n, m))))
        sums = mixed(x)[picks].sum(axis=1, dtype=np.uint64)
        out.append(mixed(sums + kind))
    return (np.concatenate(out) >> np.uint64(1)) | np.uint64(1)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose key occurs in two classes or more, of the ranges in a task."""
    held: dict[int, list] = {}
    kinds = {"key": np.int64, "sid": np.int64, "n": np.int32, "place": np.int32}

    def out(columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], list(kinds))

    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.column("r")[row].as_py()
            part = [np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in kinds.items()]
            if r < 0:
                yield out(part)
            else:
                held.setdefault(r, []).append(part)
    while held:
        columns = [np.concatenate(x) for x in zip(*held.popitem()[1], strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        key, sid, *_ = columns = [x[order] for x in columns]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, *_ = columns = [x[fresh] for x in columns]
        near = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        near[1:] |= same
        near[:-1] |= same
        yield out([x[near] for x in columns])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a task whose whole sets reach the threshold."""
    cuts = WordSlices(most=SLICE), WordSlices(most=SLICE)

    def sets(cut, column):
        return (x for s in cut.slices(column) for x in s.shingle_sets(WIDTH))

    for batch in batches:
        keep = []
        both_sets = (sets(cut, batch.column(name)) for cut, name in zip(cuts, ("text_a", "text_b"), strict=True))
        for x, y in zip(*both_sets, strict=True):
            both = len(x) + len(y) - len(unique(np.concatenate((x, y))))
            keep.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        pa.default_memory_pool().release_unused()


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""

    def cost(x: int) -> float:
        light = sum(count * subsets(n, x) for n, count in sizes.items() if n <= x)
        heavy = sum(count * listed(n) * list_length for n, count in sizes.items() if DEN * n > NUM * x)
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def _plan(described: DataFrame) -> tuple[Plan, int]:
    frequent = described.where("frequent").groupBy("one").agg(F.sum("n").alias("df"))
    top = frequent.orderBy(F.desc("df"), "one").limit(FREQUENT).toArrow()
    h = top["one"].to_numpy().view(np.uint64)
    df = top["df"].to_numpy()
    order = np.argsort(h)
    # rarer first; equal counts by hash
    rank = np.empty(len(h), np.uint64)
    rank[np.lexsort((h, df))] = np.arange(len(h), dtype=np.uint64) * np.uint64(2)
    sizes = described.where(f"not frequent and n between 1 and {LIGHT_MOST * 2}").groupBy("n").count()
    sizes = {r[0]: r[1] for r in sizes.collect()}  # at most 48 rows
    total = described.where("not frequent").agg(F.sum("n")).first()[0] or 0
    squares = float((df.astype(float) ** 2).sum())
    length = (squares + max(0.0, total - float(df.sum()))) / max(1, total)
    return Plan(h[order], rank[order], choose_boundary(sizes, length)), total


def _texts(rows: DataFrame, twice: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of each row of ``wanted``, once."""
    # rows repeated in full are few, and only they are brought together
    row = ["doc_id", "text_hash"]
    wanted = broadcast_if_small(wanted.select(*row, "sid"), TEXTS_IN_PLACE)
    single = rows.join(twice, row, "left_anti").join(wanted, row)
    repeated = rows.join(twice, row, "left_semi").join(wanted, row).dropDuplicates(row)
    return single.unionByName(repeated).select("sid", "text")


def _verified(pairs: DataFrame, rows: DataFrame, twice: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) that reach the threshold. Starts jobs."""
    # only texts of pairs are fetched, and kept no longer than it takes to check them
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = landed(_texts(rows, twice, reps.join(ends, "sid", "left_semi")), "pair-texts")
    both = pairs
    for end in "ab":
        both = both.join(texts.select(F.col("sid").alias(end), F.col("text").alias(f"text_{end}")), end)
    both = both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long").distinct()
    links = landed(both, "links")
    dropped(texts)
    return links


def similar_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, checked_links. Starts jobs.

    ``checked_links`` counts the links of the document's class that were checked;
    inside a component most need no check, so it is no count of similar texts.
    """
    with shuffles_freed(docs.sparkSession), small_batches(docs.sparkSession):
        return _similar_components(docs)


def _similar_components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    # a document without doc_id goes by a number above all others, which names no component
    rows = docs.selectExpr("cast(doc_id as long) given", "coalesce(text, '') text")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    nameless = F.col("text_hash").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(NAMELESS))
    rows = rows.select(F.coalesce("given", nameless).alias("doc_id"), "text", "text_hash")
    schema = "doc_id long, text_hash long, n long, one long, two long, frequent boolean"
    all_described = landed(rows.mapInArrow(_describe, schema), "shingle-sets")
    plan, total = _plan(all_described)
    described = all_described.where("not frequent")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (3 * ENTRIES))
    packed = rows.select("text").mapInArrow(_entries(plan, ranges), "r int, key binary, sid binary, n binary, place binary")
    dealt = packed.withColumn("salt", F.when(F.col("r") < 0, F.xxhash64("sid")).otherwise(0))
    dealt = dealt.repartition(ranges, "r", "salt").drop("salt")
    entries = landed(dealt.mapInArrow(_shared, "key long, sid long, n int, place int"), "listed")
    # entries of frequent shingles came straight from the tasks: classes in several tasks repeat
    shared = landed(entries.where("key >= 0").unionByName(entries.where("key < 0").distinct()), "lists")
    dropped(entries)

    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    sets = described.where("n > 0").groupBy("n", "one", "two").agg(first, F.count(F.lit(1)).alias("copies"))
    sets = sets.select("n", "one", "two", "copies", "first.*")
    schema = "n long, one long, two long, copies long, doc_id long, text_hash long, sid long"
    reps = landed(sets.mapInArrow(_with_class, schema).join(shared.select("sid").distinct(), "sid", "left_semi"), "set-classes")
    row = ["doc_id", "text_hash"]
    twice = landed(described.groupBy(*row).count().where("count > 1").select(*row), "repeated-rows")

    pairs = _leading_pairs(shared)
    leading = _verified(pairs, rows, twice, reps)
    dropped(pairs)
    parts = components(leading)
    # classes are the nodes: a doc_id may stand in several
    pairs = _crossing_pairs(shared, parts.withColumnRenamed("node", "sid"))
    dropped(shared)
    crossing = _verified(pairs, rows, twice, reps)
    links = landed(leading.unionByName(crossing).distinct(), "links")
    dropped(leading, crossing, pairs, twice)

    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("checked_links"))
    linked = reps.join(components(links).join(degree, "node"), F.col("sid") == F.col("node"))
    linked = landed(linked.select("n", "one", "two", "doc_id", "component", "checked_links"), "linked-classes")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked_sets = linked.join(least, "component").select("n", "one", "two", "least", "checked_links")
    # documents follow their class; a class of one without links needs no lookup
    copied = sets.where("copies > 1").select("n", "one", "two", F.col("doc_id").alias("first"))
    classes = landed(linked_sets.join(copied, ["n", "one", "two"], "full"), "classes")
    dropped(reps, links, linked)
    name = F.coalesce("least", "first", "doc_id")
    return described.join(classes, ["n", "one", "two"], "left").select(
        F.when(F.col("doc_id") < NAMELESS, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(name < NAMELESS, name).alias("component_id"),
        F.coalesce("checked_links", F.lit(0)).cast("long").alias("checked_links"),
    )


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [_class(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("n", "one", "two")), strict=True)]
        yield batch.append_column("sid", pa.array(names, pa.int64()))


def _leading_pairs(shared: DataFrame) -> DataFrame:
    """Every set with the set that leads most of its lists, among sets of like size.

    A list is led by the set whose own lists are longest in sum: an original
    shares more with its copies than they do among each other. Leaders of one
    list in neighbouring sizes are paired too.
    """
    lengths = shared.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    weights = shared.join(lengths, "key").groupBy("sid").agg(F.sum("length").alias("weight"))
    size = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int").alias("size")
    lists = shared.join(weights, "sid").select("key", "sid", "n", "weight", size)
    leaders = lists.groupBy("key", "size").agg(F.max(F.struct("weight", "sid", "n")).alias("top"))
    leaders = landed(leaders.select("key", "size", "top.sid", "top.n"), "leaders")
    votes = shared.select("key", size, F.col("sid").alias("a"), "n").join(
        leaders.select("key", "size", F.col("sid").alias("b")), ["key", "size"]
    )
    across = leaders.select("key", (F.col("size") + 1).alias("size"), F.col("sid").alias("a"), "n").join(
        leaders.select("key", "size", F.col("sid").alias("b")), ["key", "size"]
    )
    votes = votes.where("a <> b").groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("votes"))
    across = across.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("votes"))
    # a pair that shares few of the listed shingles is left to the crossing pairs
    enough = F.col("votes") * 5 * DEN >= F.col("n") * (DEN - NUM)
    best = votes.where(enough).groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best"))
    pairs = best.select("a", F.col("best.b").alias("b")).unionByName(across.where(enough).select("a", "b"))
    pairs = landed(pairs.distinct(), "leading-pairs")
    dropped(leaders)
    return pairs


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")


def meeting(entries: DataFrame) -> DataFrame:
    """Add to list entries their size ``own`` and the sizes ``other`` (classes) of sets they may meet.

    A pair's first common shingle, at places p and q of sets of n and m, leaves
    min(n - p, m - q) shingles to share. That must reach the overlap asked for, so
    an entry far back in its set meets small sets only, or none of a list. A
    shared subset is a link at any place.
    """
    least = F.ceil(F.col("n") * NUM / DEN)
    most = F.floor(F.col("n") * DEN / NUM)
    reach = F.floor((F.col("n") - F.col("place")) * (NUM + DEN) / NUM) - F.col("n")
    most = F.when(F.col("key") % 2 != 0, most).otherwise(F.least(most, reach))
    others = F.sequence(size_class(least), size_class(most))
    return entries.where(most >= least).select("*", size_class(F.col("n")).alias("own"), F.explode(others).alias("other"))


def _crossing_pairs(shared: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of classes in one list, of different components, that can reach the threshold."""
    part = F.when(F.col("component").isNull(), F.xxhash64(F.lit("alone"), "sid")).otherwise(
        F.xxhash64(F.lit("linked"), "component")
    )
    lists = shared.join(known, "sid", "left").select("key", "sid", "n", "place", part.alias("part"))
    lists = landed(lists, "list-parts")
    sizes = lists.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").select("key", F.col("main.part").alias("main"))
    spanning = lists.join(main, "key").withColumn("main", F.col("part") == F.col("main"))
    spanning = landed(meeting(spanning), "spanning-lists")
    dropped(lists)
    # both must be able to meet sets of the other's size
    few = spanning.where("not main").select(
        "key",
        F.col("own").alias("other"),
        F.col("other").alias("own"),
        *(F.col(x).alias(f"{x}_a") for x in ("sid", "n", "place", "part")),
    )
    need = F.ceil((F.col("n") + F.col("n_a")) * NUM / (NUM + DEN))
    pairs = few.join(spanning, ["key", "own", "other"]).where(
        (F.col("part_a") != F.col("part"))
        & (F.col("main") | (F.col("sid_a") < F.col("sid")))
        & (DEN * F.least("n", "n_a") >= NUM * F.greatest("n", "n_a"))
        # the first shingle that two similar sets share has `need` - 1 more after it in both
        & ((F.col("key") % 2 != 0) | ((F.col("place") <= F.col("n") - need) & (F.col("place_a") <= F.col("n_a") - need)))
    )
    pairs = pairs.select(F.least("sid_a", "sid").alias("a"), F.greatest("sid_a", "sid").alias("b")).distinct()
    pairs = landed(pairs, "crossing-candidates")
    dropped(spanning)
    # the listed shingles of a set are few: count what a pair shares before texts are fetched
    whole = shared.groupBy("sid", "n").agg(F.collect_set("key").alias("keys"))
    one, two = (whole.select(*(F.col(c).alias(f"{c}_{x}") for c in whole.columns)) for x in "ab")
    both = F.array_intersect("keys_a", "keys_b")
    rest = F.ceil(F.greatest("n_a", "n_b") * NUM / DEN) - 1  # beyond its listed shingles a set has so many
    need = F.ceil((F.col("n_a") + F.col("n_b")) * NUM / (NUM + DEN))
    subset = F.exists(both, lambda key: key % 2 != 0)
    counted = pairs.join(one, F.col("a") == F.col("sid_a")).join(two, F.col("b") == F.col("sid_b"))
    found = landed(counted.where(subset | (F.size(both) + rest >= need)).select("a", "b"), "crossing-pairs")
    dropped(pairs)
    return found
