"""How quality filters interact, over a sparse document-term matrix.

Five filters judge every text: A too few words, B too few distinct words for its
length, C too many capitals, D a forbidden symbol, E the text of a smaller
doc_id. The audit tells, for every order of the filters, what each step keeps
and removes, what an earlier step had removed already, and what it costs.

1. Blocks of documents are cut into words; a block numbers its own words and
   holds its counts as compressed sparse rows (``indptr``, ``indices``, ``data``).
2. The words of all blocks are dealt by hash into ranges, numbered in each and
   then throughout: the global dictionary. A task holds one range's distinct words.
3. Each block gets the global numbers of its words, which turns it into a shard
   of the one document-term matrix. Words travel once per block, not per text,
   and packed: a row per block and range.
4. A text's row sum is its number of words, its nonzero entries are its distinct
   words: they decide A and B. The other flags and labels are attached, and all
   is counted per part and set of failed filters, 32 sets at most a part.
5. Orders and steps read those counts. Which filters came before a step is all
   that matters, so 80 cases a part give all 120 orders.

Cases: null text is empty and has no words, so it fails A; empty texts are
identical to each other; null lang is the part ''; a document without doc_id
has no smaller one, is smaller than none, and has no labels; rows that repeat a
doc_id are documents of their own and don't make each other duplicates; of
several labels for a doc_id any that says 1 counts; a text of any length is a
block of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import SPACES, byte_slices, mixed
from tracewell.operators.sizes import landed

MIN_WORDS = 200
DISTINCT_SHARE = 50  # least distinct words in 100
CAPITAL_SHARE = 3  # most capitals in 100 characters
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"
BLOCK_BYTES = 4 << 20  # text of a block: a larger one repeats fewer words

RANGES = 4  # ranges of words per shuffle partition: one is numbered at a time

# a block's texts and sparse rows (packed int32), or its words of one range, a line each
_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("r", pa.int32()),
        ("words", pa.string()),
        ("doc_id", pa.list_(pa.int64())),
        ("part", pa.list_(pa.string())),
        ("digest", pa.list_(pa.binary())),
        ("capitals", pa.list_(pa.int64())),
        ("points", pa.list_(pa.int64())),
        ("symbol", pa.list_(pa.bool_())),
        ("indptr", pa.list_(pa.int64())),
        ("local", pa.binary()),
        ("counts", pa.binary()),
    ]
)
_TEXTS = (
    "doc_id array<long>, part array<string>, digest array<binary>, capitals array<long>, points array<long>, "
    "symbol array<boolean>, indptr array<long>"
)
_TEXT_COLUMNS = [field.split()[0] for field in _TEXTS.split(", ")]
_BLOCK_SQL = f"block long, r int, words string, {_TEXTS}, local binary, counts binary"


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text; flags are set at few bytes."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def local_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts laid end to end, and their counts as sparse rows."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    inside = inside[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[inside].tobytes())]
    ).dictionary_encode()
    distinct = words.dictionary
    row = np.searchsorted(offsets, start, "right") - 1
    cell = row * np.int64(max(1, len(distinct))) + words.indices.to_numpy(zero_copy_only=False)
    cell.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
    counts = np.diff(np.concatenate((first, [len(cell)]))).astype(np.int32)
    row, indices = np.divmod(cell[first], np.int64(max(1, len(distinct))))
    indptr = np.searchsorted(row, np.arange(len(offsets)))
    return distinct, indptr, indices.astype(np.int32), counts


def _ranges_of(words: pa.Array, ranges: int) -> np.ndarray:
    """The range of each word, by a hash of its bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    at = mixed(data + (within.astype(np.uint64) << np.uint64(8)))
    return (mixed(np.add.reduceat(at, offsets[:-1])) % np.uint64(ranges)).astype(np.int64)


def _blocks(ranges: int):
    """Slices of texts: who they are, their flags, their words in sparse rows; and the words by range."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    byte = np.arange(256)
    capital, inner = (byte >= 65) & (byte <= 90), (byte & 0xC0) == 0x80  # inner: bytes that begin no character

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in byte_slices(batch.column("text"), BLOCK_BYTES):
                own = batch.slice(s.first, s.n)
                words, indptr, indices, counts = local_terms(s.data, s.offsets)
                # number the words range by range
                r = _ranges_of(words, ranges)
                order = np.argsort(r, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                per_text = [own.column(c) for c in ("doc_id", "part", "digest")] + [
                    pa.array(_count(capital[s.data], s.offsets)),
                    pa.array(np.diff(s.offsets) - _count(inner[s.data], s.offsets)),
                    pa.array(_count(symbol[s.data], s.offsets) > 0),
                    pa.array(indptr, pa.int64()),
                ]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in per_text]
                packed = [pa.array([x.tobytes()]) for x in (place[indices], counts)]
                row = [pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays([*row, *lists, *packed], schema=_BLOCK)
                names, edges = words.take(pa.array(order)).to_pylist(), np.searchsorted(r[order], np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(edges)).tolist()
                texts = [b"\n".join(names[edges[k] : edges[k + 1]]) for k in some]
                row = [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(texts).cast(pa.string())]
                rest = [pa.nulls(len(some), field.type) for field in list(_BLOCK)[3:]]
                yield pa.RecordBatch.from_arrays([*row, *rest], schema=_BLOCK)
                block += 1

    return run


_NUMBERED = "block long, r int, words string, numbers binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, from 0 in each range, of the words of blocks; then the range's words (block null).

    Rows come sorted by range. Only a range's distinct words are held.
    """
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary())
    names = [field.split()[0] for field in _NUMBERED.split(", ")]
    now, known = None, {}

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    for batch in batches:
        rows = []
        for block, r, words in zip(*(batch.column(c).to_pylist() for c in ("block", "r", "words")), strict=True):
            if r != now:
                if known:
                    rows.append((None, now, "\n".join(known), None))
                now, known = r, {}
            numbers = [known.setdefault(word, len(known)) for word in words.split("\n")]
            rows.append((block, r, None, np.array(numbers, np.int32).tobytes()))
        if rows:
            yield out(rows)
    if known:
        yield out([(None, now, "\n".join(known), None)])


def document_term_shards(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, shards) of the document-term matrix of ``docs``. Starts jobs.

    ``dictionary``: term_id (from 0, without gaps), word. ``shards``: per block
    the arrays doc_id, part, digest, capitals, points, symbol, one value a text,
    and the sparse rows ``indptr``, ``indices`` (term ids) and ``data`` (counts).
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = landed(rows.mapInArrow(_blocks(RANGES * partitions), _BLOCK_SQL), "term-blocks")
    words = blocks.where("r is not null").select("block", "r", "words")
    words = words.repartition(partitions, "r").sortWithinPartitions("r", "block")
    numbered = landed(words.mapInArrow(_numbered, _NUMBERED), "term-numbers")
    terms = numbered.where("block is null").select("r", F.split("words", "\n").alias("words"))
    sizes = dict(terms.groupBy("r").agg(F.sum(F.size("words"))).collect())  # one row per range
    first = np.array([sizes.get(r, 0) for r in range(RANGES * partitions)], np.int64)
    first = np.cumsum(first) - first
    offsets = spark.createDataFrame(list(enumerate(first.tolist())), "r int, first long")
    dictionary = terms.join(F.broadcast(offsets), "r").select("first", F.posexplode("words").alias("place", "word"))
    dictionary = dictionary.select((F.col("first") + F.col("place")).alias("term_id"), "word")
    numbers = numbered.where("block is not null").groupBy(F.col("block").alias("_block"))
    numbers = numbers.agg(F.collect_list(F.struct("r", "numbers")).alias("numbers"))
    shards = blocks.where("r is null").drop("r", "words").join(numbers, F.col("block") == F.col("_block"), "left")
    schema = f"block long, {_TEXTS}, indices array<long>, data array<int>"
    return dictionary, shards.drop("_block").mapInArrow(_renumbered(first), schema)


def _renumbered(first: np.ndarray):
    """Sparse rows with the corpus's numbers of words in place of the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1)
                ranges = sorted((x["r"], x["numbers"]) for x in block.column("numbers")[0].as_py() or ())
                terms = [first[r] + np.frombuffer(numbers, np.int32) for r, numbers in ranges]
                terms = np.concatenate(terms) if terms else np.empty(0, np.int64)
                local, counts = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in ("local", "counts"))
                edges = pa.array([0, len(local)], pa.int32())
                cells = (pa.ListArray.from_arrays(edges, pa.array(x)) for x in (terms[local], counts))
                kept = [block.column(c) for c in ("block", *_TEXT_COLUMNS)]
                yield pa.RecordBatch.from_arrays([*kept, *cells], ["block", *_TEXT_COLUMNS, "indices", "data"])

    return run


_ROW = "doc_id long, part string, digest binary, n_words long, n_distinct long, capitals long, points long, symbol boolean"


def _row_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and nonzero counts of shards, one row per text."""
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1)
            indptr, data = (block.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("indptr", "data"))
            total = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))[indptr]
            own = {c: block.column(c).flatten() for c in ("doc_id", "part", "digest", "capitals", "points", "symbol")}
            facts = {"n_words": pa.array(np.diff(total)), "n_distinct": pa.array(np.diff(indptr), pa.int64())}
            order = [field.split()[0] for field in _ROW.split(", ")]
            yield pa.RecordBatch.from_pydict({name: (own | facts)[name] for name in order})


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, part, n_words, n_distinct, failed (bits of A to E), good, toxic. Starts jobs."""
    _, shards = document_term_shards(docs)
    facts = landed(shards.mapInArrow(_row_facts, _ROW), "row-facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first_id")).where("first_id is not null")
    first = first.withColumn("is_first", F.lit(True)).withColumnsRenamed({"digest": "first_digest"})
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    # rows without a doc_id meet nobody, so they stay out of the joins
    known = facts.where("doc_id is not null")
    known = known.join(first, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    known = known.join(said, F.col("doc_id") == F.col("label_id"), "left").withColumn("copy", F.col("is_first").isNull())
    no = F.lit(False)
    unknown = facts.where("doc_id is null").withColumns({"copy": no, "good": no, "toxic": no})
    rows = known.select(*unknown.columns).unionByName(unknown)
    fails = (
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < DISTINCT_SHARE * F.col("n_words"),
        100 * F.col("capitals") > CAPITAL_SHARE * F.col("points"),
        F.col("symbol"),
        F.col("copy"),
    )
    failed = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    mine = [F.coalesce(x, no).alias(x) for x in ("good", "toxic")]
    return rows.select("doc_id", "part", "n_words", "n_distinct", failed.alias("failed"), *mine)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step the counts of the audit. Starts jobs."""
    spark, n = docs.sparkSession, len(FILTERS)
    one = F.count(F.lit(1))
    cells = judged(docs, labels).groupBy("part", "failed").agg(
        one.alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    cells = landed(cells, "audit-cells")
    # fixed tables: what a step sees of documents that fail a given set, and the steps of all orders
    effects, steps = [], []
    for k in range(n):
        for before in range(1 << n):
            if before >> k & 1:
                continue
            ways = factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())
            for failed in range(1 << n):
                fails, gone = bool(failed >> k & 1), bool(failed & before)
                flags = (not fails and not gone, fails and not gone, fails and gone, failed == 1 << k)
                effects.append((failed, before, k, ways, *map(int, flags)))
    for order in permutations(range(n)):
        for step, k in enumerate(order):
            before = sum(1 << x for x in order[:step])
            steps.append(("".join(FILTERS[x] for x in order), step + 1, before, k))
    effects = spark.createDataFrame(
        effects, "failed int, before int, k int, ways long, keeps int, removes int, again int, alone int"
    )
    steps = spark.createDataFrame(steps, "filter_order string, step int, before int, k int")
    counts = {
        "kept": F.col("n") * F.col("keeps"),
        "removed": F.col("n") * F.col("removes"),
        "redundant": F.col("n") * F.col("again"),
        "unique_fails": F.col("n") * F.col("alone"),
        "good_lost": F.col("n_good") * F.col("removes"),
        "toxic_lost": F.col("n_toxic") * F.col("removes"),
    }
    cases = cells.join(F.broadcast(effects), "failed").groupBy("part", "before", "k", "ways").agg(
        *(F.sum(x).alias(name) for name, x in counts.items())
    )
    cases = landed(cases, "audit-cases")
    worth = cases.groupBy(F.col("part").alias("p"), F.col("k").alias("f")).agg(
        F.sum(F.col("ways") * F.col("removed")).alias("shapley")
    )
    cases = cases.join(worth, (F.col("part") == F.col("p")) & (F.col("k") == F.col("f")))
    return cases.join(F.broadcast(steps), ["before", "k"]).select(
        "part", "filter_order", "step", *(F.col(name).cast("long").alias(name) for name in counts), "shapley"
    )
