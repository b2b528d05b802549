"""Token ids as Parquet list columns, one row per document, in order of doc_id.

Texts are range-sorted by doc_id, encoded in that order and written as the file
format: columns ``part`` (the file's number), ``doc_id``, ``first`` (ids before
the document in its file), ``n_tokens`` and ``ids`` (``list<int>``). Ids are
dictionary-encoded and the counters delta-encoded (or both delta:
``encoding="delta"``), row groups and pages are kept small and carry column and
offset indexes. So a reader of counts touches no token page, and a reader of some
documents only the pages that hold them.

A byte-level tokenizer splits texts by a pattern first and merges within the
pieces only. Texts are cut where that pattern splits whatever stands around, each
distinct piece of a task is encoded once by the library, and ids are put together
by gathering. A text that holds an added token is not cut, nor are texts at
characters whose kind is not plain.

Cases: null and empty texts hold the end id only; null doc_id comes first; rows
of one doc_id go by the hash of their ids, and rows repeated in full are rows of
their own; a text of any length is encoded whole; an empty table gives empty
files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.words import byte_slices
from tracewell.operators.sizes import landed

END = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
LONGEST = 64  # bytes of a piece that is remembered
AT_ONCE = 4096  # pieces given to the library in one call, whose results are large
JOINED = 256  # of these so many make one text, with an added token behind each
REMEMBERED = 400_000  # pieces; when a worker has met more, those met in one slice only are forgotten

PARTS = 1000  # files whose totals are summed together

FILE = "part int, doc_id long, first long, n_tokens long, ids array<int>"


# kinds of bytes; at those of kind UNKNOWN a text is not cut
UNKNOWN, BLANK, BREAK, LETTER, DIGIT, QUOTE, MARK = range(7)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, UNKNOWN, np.int8)
    for byte in range(0x21, 0x7F):
        kind[byte] = LETTER if chr(byte).isalpha() else DIGIT if chr(byte).isdigit() else MARK
    kind[ord("'")] = QUOTE
    kind[ord(" ")] = BLANK
    kind[list(b"\t\n\r")] = BREAK
    kind[0xC3:0xC9] = LETTER  # leads of U+00C0 to U+023F, which are letters but for two signs
    return kind


_KINDS = _byte_kinds()


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the byte-level pattern splits a text whatever stands around.

    Runs of letters, digits and marks are pieces, with one blank before them; a
    quote may take letters after it; the last of several blanks and breaks goes
    with what follows, and a break is a piece of its own.
    """
    n = len(data)
    if n < 2:
        return np.empty(0, np.int64)
    kind = _KINDS[data]
    lead = kind[:-1] * ((data[:-1] >= 0xC3) & (data[:-1] < 0xC9)) == LETTER
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    kind[1:][lead] = LETTER  # the second byte of a two-byte letter
    kind[:-1][sign] = UNKNOWN
    kind[1:][sign] = UNKNOWN
    left, right = kind[:-1], kind[1:]
    blank = (kind == BLANK) | (kind == BREAK)
    shown = kind >= LETTER
    cut = shown[:-1] & blank[1:]
    cut |= (left == BREAK) & shown[1:]
    cut |= (left != right) & (left >= LETTER) & (right >= LETTER) & ~((left == QUOTE) & (right != DIGIT))
    cut &= ~((left == MARK) & (right == QUOTE))
    last = blank[:-2] & blank[1:-1] & shown[2:]
    inside = offsets[1:-1]
    last[inside[(inside >= 2) & (inside < n)] - 2] = False  # what follows belongs to another text
    cut[:-1] |= last
    return np.flatnonzero(cut) + 1


class Encoder:
    """Encodes slices of texts; remembers the ids of short pieces between slices."""

    def __init__(self, path: str, end: int, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.whole = Tokenizer.from_file(path), end, whole
        tokens = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in tokens.values()]
        # what stands on either side of such a token is encoded as if it stood alone
        plain = (x for x, t in tokens.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.mark = None if whole else next(plain, None)
        self.marker = b"" if self.mark is None else tokens[self.mark].content.encode()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.flat = array("q", [0]), array("i")
        self.met = array("i")  # in how many slices

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's ids begin."""
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        if not self.whole:
            at = cuts(data, offsets)
            whole = self._with_added_tokens(data, offsets)
            if len(whole):
                at = at[~np.isin(np.searchsorted(offsets, at, "right") - 1, whole)]
            begins = np.zeros(len(data) + 1, bool)
            begins[at] = begins[begin] = True
            begin = np.flatnonzero(begins)
        bounds = np.concatenate((begin, [len(data)])).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]
        ).dictionary_encode()
        # by numpy: to_pylist makes a scalar of each piece first
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = self._slots(distinct)[pieces.indices.to_numpy(zero_copy_only=False)]
        ids, reach = self._gathered(slots)
        self._trim()
        # ids of each text: those of its pieces, and the end id behind them
        edges = reach[np.searchsorted(begin, offsets)]
        at = edges + np.arange(len(offsets))
        out = np.full(at[-1], self.end, np.int32)
        own = np.ones(at[-1], bool)
        own[at[1:] - 1] = False
        out[own] = ids
        return out, at

    def _with_added_tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold a token which the library looks for before it splits anything."""
        raw, found = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each piece's begin."""
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat or bytes(), np.int32)
        first = starts[slots]
        size = starts[slots + 1] - first
        reach = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(first - reach[:-1], size)
        at += np.arange(reach[-1])
        return flat[at], reach

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of each piece stand; new pieces are encoded, long ones last."""
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(slots < 0)
        sizes = np.fromiter(map(len, map(pieces.__getitem__, fresh.tolist())), np.int64, len(fresh))
        fresh = np.concatenate((fresh[sizes <= LONGEST], fresh[sizes > LONGEST]))
        new = list(map(pieces.__getitem__, fresh.tolist()))
        self.long = int((sizes > LONGEST).sum())
        before = len(self.starts) - 1
        for first in range(0, len(new), AT_ONCE):
            ids, ends = self._encoded(new[first : first + AT_ONCE])
            self.starts.frombytes((ends + len(self.flat)).tobytes())
            self.flat.frombytes(ids.tobytes())
        self.met.frombytes(bytes(self.met.itemsize * len(new)))
        slots[fresh] = np.arange(before, before + len(new))
        short = len(new) - self.long
        self.known.update(zip(new[:short], range(before, before + short), strict=True))
        np.frombuffer(self.met, np.int32)[slots] += 1
        return slots

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library, and where each piece's end."""
        if self.mark is not None:
            joined = [self.marker.join([*pieces[i : i + JOINED], b""]) for i in range(0, len(pieces), JOINED)]
            found = self.tokenizer.encode_batch_fast(list(map(bytes.decode, joined)), add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            marks = ids == self.mark
            ends = np.flatnonzero(marks)
            if len(ends) == len(pieces):  # else a piece holds the token itself
                return ids[~marks], ends - np.arange(len(ends))
        found = self.tokenizer.encode_batch_fast(list(map(bytes.decode, pieces)), add_special_tokens=False)
        lists = [e.ids for e in found]
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1])), ends

    def _trim(self) -> None:
        """Forget long pieces, and those met in one slice only when all have become too many."""
        if self.long:
            del self.starts[len(self.starts) - self.long :], self.met[len(self.met) - self.long :]
            del self.flat[self.starts[-1] :]
        if len(self.known) <= REMEMBERED:
            return
        kept = np.flatnonzero(np.frombuffer(self.met, np.int32) > 1)
        pieces = list(self.known)  # in the order of their slots
        if 2 * len(kept) > REMEMBERED:
            kept = kept[:0]
        ids, reach = self._gathered(kept)
        self._forget()
        self.known = dict(zip(map(pieces.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.starts, self.flat = array("q", reach.tobytes()), array("i", ids.tobytes())
        self.met = array("i", bytes(4 * len(kept)))


@lru_cache(maxsize=1)
def _encoder(path: str, end: int, whole: bool) -> Encoder:
    """One a worker: its next task finds the tokenizer loaded and pieces of earlier ones encoded."""
    return Encoder(path, end, whole)


def _file_rows(path: str, end: int, whole: bool):
    """Rows of one file: the part it is, ids that come before each document, and its ids as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encoder = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            encoder = encoder or _encoder(path, end, whole)
            for s in byte_slices(batch.column("text")):
                ids, at = encoder.ids(s.data, s.offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(s.n, part, np.int32)),
                        batch.column("doc_id").slice(s.first, s.n),
                        pa.array(before + at[:-1]),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                    ],
                    ["part", "doc_id", "first", "n_tokens", "ids"],
                )
                before += int(at[-1])
            pa.default_memory_pool().release_unused()  # workers wait for their next task with what they hold

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int = END, encoding: str = "dictionary", whole: bool = False
) -> None:
    """Encode ``docs`` with the tokenizer file and write token files. Starts jobs.

    ``tokenizer`` is a path that every executor can read. ``whole`` gives whole
    texts to the library, for tokenizers whose pieces may cross single spaces.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.asc_nulls_first("doc_id")
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"), "text")
    counters = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "first", "n_tokens")}
    options = {
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding wherever there is no dictionary
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    ordered.mapInArrow(_file_rows(tokenizer, end, whole), FILE).write.options(**options, **counters).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, first, start, n_tokens) of every document; reads no token page. Starts a job.

    ``start`` counts the ids of all documents before. Totals of files are summed
    in blocks of PARTS and the blocks' totals after that.
    """
    return _started(spark, path, "part", "doc_id", "first", "n_tokens")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same with ``ids``. Filters on doc_id reach the page indexes. Starts a job."""
    return _started(spark, path, "part", "doc_id", "first", "n_tokens", "ids")


def read_window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, position, ids) of the ids from ``start`` to ``stop`` (exclusive) of all files laid end to end.

    ``position`` is the place of the first of the ids. Only files that reach into
    the window are read, and of those the pages that do. Starts jobs.
    """
    inside = _part_starts(spark, path).where((F.col("_start") < stop) & (F.col("_start") + F.col("_total") > start))
    low, high, least = inside.agg(F.min("part"), F.max("part"), F.min("_start")).first()
    if low is None:
        low, high, least = 0, -1, 0
    rows = read_documents(spark, path).where(F.col("part").between(low, high) & (F.col("first") < stop - least))
    rows = rows.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    take = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip
    ids = F.slice("ids", (skip + 1).cast("int"), take.cast("int"))
    return rows.select("doc_id", (F.col("start") + skip).alias("position"), ids.alias("ids"))


def _part_starts(spark: SparkSession, path: str) -> DataFrame:
    totals = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    totals = landed(totals.withColumn("_block", F.expr(f"part div {PARTS}")), "part-totals")
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_total").over(so_far.partitionBy("_block").orderBy("part")), F.lit(0))
    blocks = totals.groupBy(F.col("_block").alias("_b")).agg(F.sum("_total").alias("_all"))
    blocks = blocks.select("_b", F.coalesce(F.sum("_all").over(so_far.orderBy("_b")), F.lit(0)).alias("_before"))
    starts = totals.withColumn("_within", within).join(blocks, F.col("_block") == F.col("_b"))
    return starts.select("part", (F.col("_before") + F.col("_within")).alias("_start"), "_total")


def _started(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    starts = landed(_part_starts(spark, path).select(F.col("part").alias("_part"), "_start"), "part-starts")
    rows = spark.read.schema(FILE).parquet(path).select(*columns)
    start = (F.col("_start") + F.col("first")).alias("start")
    return rows.join(starts, F.col("part") == F.col("_part")).select(*columns[:3], start, *columns[3:])


def ids_crc32(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksums of ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(), "<u4")).cast("B")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = documents.select("doc_id", "start", "ids")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
