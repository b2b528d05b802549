"""Removal of repeated passages with suffix arrays of shards.

Every byte is removed that lies in a string of ``LENGTH`` bytes which starts
anywhere else too, in the same text or another. Matches are judged on the input.

1. Anchors bring equal strings together. Of all windows of LENGTH bytes the
   ``GRAM`` bytes of least hash are an anchor; equal windows have equal anchors
   at equal places. Anchors that occur once are dropped.
2. A passage's anchors share a shard: its key is what its occurrences have in
   common (their least text, and a piece of one text of ``PIECE`` bytes). The
   surroundings of anchors, all windows that can hold them, are the shard.
3. Each shard gets a suffix array by induced sorting. Windows whose permuted
   common prefix with their neighbour reaches LENGTH form a class; a class with
   two places marks all of its windows. Shards of many rows are salted first;
   a salted part hands on one window of each class, and those meet in a second
   pass.
4. Marked windows are merged and cut out of each text.

Equal texts are one text with a number of copies; with copies, a text of LENGTH
bytes or more is repeated as a whole.

Cases: null text is empty; texts below LENGTH bytes are never cut; repeated rows
are copies; bytes that remain may be no valid UTF-8, so they are kept as binary;
an empty table gives an empty result; a text of any length is one slice of its
task; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.suffix_sort import permuted_prefixes, suffix_array
from tracewell.llm.words import byte_slices, mixed, powers
from tracewell.operators.sizes import landed

LENGTH = 400
GRAM = 100
PIECE = 8192
BATCH = 1 << 20  # bytes that are sorted together
HEAVY = 10_000  # a text that this share of all rows repeat is looked up by broadcast
SALT_ROWS = 2000  # rows of a shard that go to one part

_BASE = 0x9E3779B97F4A7C15


def _running(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over ``width`` values from each place on (shorter by width - 1)."""
    reach = 1
    while 2 * reach <= width:
        x = op(x[:-reach], x[reach:])
        reach *= 2
    return op(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, power, inverse, value) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in texts laid end to end, and their hashes."""
    n, none = len(data), np.empty(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * power[:n], out=total[1:])
    h = mixed((total[gram:] - total[:-gram]) * inverse[: n - gram + 1]) | np.uint64(1)
    windows = n - length + 1
    wide = length - gram + 1
    least = _running(h, wide, np.minimum)
    # windows that reach into the next text don't count
    ends = offsets[1:]
    ends = ends[ends > offsets[:-1]]
    crossing = np.zeros(windows + 1, np.int64)
    for end in ends[:-1]:
        crossing[min(windows, max(0, end - length + 1))] += 1
        crossing[min(windows, end)] -= 1
    least[np.cumsum(crossing[:-1]) > 0] = 0
    padded = np.concatenate((np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)))
    most = _running(padded, wide, np.maximum)  # over the windows that hold each place
    at = np.flatnonzero(most == h)
    return at, h[at]


def _scan(length: int, gram: int):
    """Per text its size and digest; per distinct text of a task its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        value = mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))
        power = powers(1, _BASE)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("tid").to_numpy(zero_copy_only=False)
            for s in byte_slices(batch.column("text")):
                if len(s.data) >= len(power):
                    power, inverse = powers(len(s.data) + 1, _BASE), powers(len(s.data) + 1, pow(_BASE, -1, 1 << 64))
                raw = s.data.tobytes()
                bounds = s.offsets.tolist()
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                own = keys[s.first : s.first + s.n]
                yield _batch(ids.slice(s.first, s.n), own, np.diff(s.offsets), digest, None, None)
                fresh = np.array([k not in seen for k in own.tolist()], bool)
                seen.update(own.tolist())
                if fresh.any() and len(s.data):
                    at, h = anchors(s.data, s.offsets, length, gram, power, inverse, value)
                    doc = np.searchsorted(s.offsets, at, "right") - 1
                    keep = fresh[doc]
                    at, h, doc = at[keep], h[keep], doc[keep]
                    yield _batch(None, own[doc], None, None, h.view(np.int64), at - s.offsets[doc])

    def _batch(ids, tid, size, digest, h, pos):
        n = len(tid)

        def column(x, kind):
            return pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)

        return pa.RecordBatch.from_arrays(
            [column(ids, pa.int64()), column(tid, pa.int64()), column(size, pa.int64()), column(digest, pa.binary()), column(h, pa.int64()), column(pos, pa.int64())],
            ["doc_id", "tid", "n_bytes", "digest", "h", "pos"],
        )

    return run


def _surroundings(places: np.ndarray, size: int, length: int, gram: int) -> list[tuple[int, int]]:
    """Merged byte ranges around anchors: all windows that hold one."""
    start = np.maximum(places - (length - gram), 0)
    end = np.minimum(places + length, size)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(start)])) - 1
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


def _segments(length: int, gram: int):
    """The surroundings of each shard's anchors, cut from their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tid, text, shards in zip(*(batch.column(c) for c in ("tid", "text", "shards")), strict=True):
                tid, text = tid.as_py(), text.as_py().encode()
                for s in shards.as_py():
                    places = np.sort(np.array(s["places"], np.int64))
                    for a, b in _surroundings(places, len(text), length, gram):
                        if b - a >= length:
                            rows.append((s["leader"], s["piece"], s["part"], tid, a, text[a:b]))
                    if len(rows) >= 2000:
                        yield _table(rows, _PIECES)
                        rows = []
            yield _table(rows, _PIECES)

    return run


_PIECES = "leader long, piece long, part long, tid long, start long, body binary"
_MARKED = "leader long, piece long, part long, tid long, start long, end long, body binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def repeated_windows(rows: list[tuple[int, int, bytes]], known: int, length: int):
    """Windows of rows (text, start, bytes) that occur at two places or more.

    Gives back (row, offset) pairs of marked windows, and of windows to hand on:
    one of each class that has no member in the first ``known`` rows. Places
    that several rows hold are one place.
    """
    sizes = np.array([len(body) for _, _, body in rows], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    t = np.frombuffer(b"\0".join(body for _, _, body in rows) + b"\0\0", np.uint8).astype(np.int16) + 2
    ends = begin + sizes
    t[ends] = 1
    t[-1] = 0
    order = suffix_array(t, length + 1)
    before, shared = permuted_prefixes(t, order, length)
    row_of = np.repeat(np.arange(len(rows)), sizes + 1)
    row_of = np.concatenate((row_of, [len(rows) - 1]))
    offset = np.arange(len(t)) - begin[row_of]
    valid = offset + length <= sizes[row_of]
    order = order[valid[order]]
    if not len(order):
        return (order, order), (order, order)
    # neighbours among valid windows are neighbours among all, if they are equal
    head = np.ones(len(order), bool)
    head[1:] = ~(shared[order[1:]] & (before[order[1:]] == order[:-1]))
    starts = np.flatnonzero(head)
    texts, text_of = np.unique(np.array([tid for tid, _, _ in rows], np.int64), return_inverse=True)
    place = text_of[row_of[order]] * np.int64(1 << 40) + np.array([s for _, s, _ in rows], np.int64)[row_of[order]] + offset[order]
    twice = np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
    cls = np.cumsum(head) - 1
    marked = order[twice[cls]]
    first = np.minimum.reduceat(order, starts)
    first = first[row_of[first] >= known]
    return (row_of[marked], offset[marked]), (row_of[first], offset[first])


def _ranges(row: np.ndarray, offset: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of merged windows."""
    if not len(row):
        return
    order = np.lexsort((offset, row))
    row, offset = row[order], offset[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (offset[1:] > offset[:-1] + length)
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(row)])) - 1
    yield from zip(row[first].tolist(), offset[first].tolist(), (offset[last] + length).tolist(), strict=True)


def _sort_shards(length: int):
    """Marked ranges (body null) of shards in sorted order, and what salted parts hand on."""

    def work(rows, known, carry):
        """Marked ranges of rows; adds to ``carry`` a window of each new class."""
        marked, fresh = repeated_windows([r[3:] for r in rows], known, length)
        out = [(*rows[k][:4], rows[k][4] + a, rows[k][4] + b, None) for k, a, b in _ranges(*marked, length)]
        new = [(*rows[k][:4], rows[k][4] + a, rows[k][5][a:b]) for k, a, b in _ranges(*fresh, length)]
        carry += new
        out += [(*r[:5], r[4] + len(r[5]), r[5]) for r in new if r[2] >= 0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shards that fit are sorted together; a larger one goes batch by batch, with what it has carried on
        whole, whole_size, now, now_size, carry, shard = [], 0, [], 0, [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if row[:3] != shard:
                    if carry:
                        out += work(carry + now, len(carry), [])
                    else:
                        whole, whole_size = whole + now, whole_size + now_size
                    if whole_size >= BATCH:
                        out += work(whole, 0, [])
                        whole, whole_size = [], 0
                    now, now_size, carry, shard = [], 0, [], row[:3]
                now.append(row)
                now_size += len(row[5])
                if now_size >= BATCH:
                    out += work(carry + now, len(carry), carry)
                    now, now_size = [], 0
            yield _table(out, _MARKED)
        out = work(carry + now, len(carry), []) if carry else []
        rest = whole if carry else whole + now
        yield _table(out + (work(rest, 0, []) if rest else []), _MARKED)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their marked ranges."""
    for batch in batches:
        rows = []
        for tid, text, ranges in zip(*(batch.column(c) for c in ("tid", "text", "ranges")), strict=True):
            text, spans = text.as_py().encode(), []
            for r in sorted((r["start"], r["end"]) for r in ranges.as_py()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            removed = len(text) - len(kept)
            rows.append((tid.as_py(), hashlib.sha256(text).digest(), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept))
        yield _table(rows, _KEPT)


_KEPT = "tid long, digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept. Starts jobs.

    ``kept`` has the remaining bytes, and is null where nothing was removed.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))
    schema = "doc_id long, tid long, n_bytes long, digest binary, h long, pos long"
    scanned = landed(rows.mapInArrow(_scan(length, gram), schema), "anchors")
    texts = scanned.where("h is null").select("doc_id", "tid", "n_bytes", "digest")
    found = scanned.where("h is not null").select("tid", "h", "pos")

    groups = found.groupBy("h").agg(
        F.min("tid").alias("leader"), F.max("tid").alias("last"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    groups = groups.where("leader <> last or low <> high")
    groups = landed(groups.select("h", "leader", F.expr(f"high div {PIECE}").alias("piece")), "shared-anchors")
    placed = found.join(groups, "h").groupBy("leader", "piece", "tid").agg(F.collect_set("pos").alias("places"))
    placed = landed(placed, "placed-anchors")
    large = placed.groupBy("leader", "piece").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > SALT_ROWS)
    large = landed(large, "large-shards")
    parts = F.ceil(F.col("texts") / SALT_ROWS)
    part = F.when(F.col("texts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("tid"), parts)).cast("long")
    shards = placed.join(large, ["leader", "piece"], "left").groupBy("tid").agg(
        F.collect_list(F.struct("leader", "piece", part.alias("part"), "places")).alias("shards")
    )
    # one row stands for all copies of a text
    first = texts.groupBy("tid").agg(F.min("doc_id").alias("first_id"))
    shards = shards.join(first, "tid").withColumnRenamed("tid", "shard_tid")
    bodies = rows.join(shards, (rows["tid"] == shards["shard_tid"]) & rows["doc_id"].eqNullSafe(shards["first_id"]))
    bodies = landed(bodies.select("tid", "text", "shards"), "shard-texts")

    pieces = bodies.mapInArrow(_segments(length, gram), _PIECES)
    key = ["leader", "piece", "part"]
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "tid", "start")
    marked = landed(pieces.mapInArrow(_sort_shards(length), _MARKED), "marked")
    handed = marked.where("body is not null").select("leader", "piece", F.lit(-1).cast("long").alias("part"), "tid", "start", "body")
    handed = handed.repartition(*key[:2]).sortWithinPartitions(*key, "tid", "start")
    again = landed(handed.mapInArrow(_sort_shards(length), _MARKED), "marked-again")
    ranges = marked.unionByName(again).where("body is null").groupBy("tid")
    ranges = ranges.agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    cut = landed(bodies.select("tid", "text").join(ranges, "tid").mapInArrow(_cut, _KEPT), "cut").dropDuplicates(["tid", "digest"])

    copies = texts.groupBy("tid", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = landed(copies, "copies")
    # texts that make up a HEAVY-th of all rows are that many at most: their rows look them up in place
    n = texts.count()
    heavy = copies.where(F.col("copies") * HEAVY >= n)
    key = ["tid", "digest"]
    hot = texts.join(F.broadcast(heavy), key).select(*texts.columns, "copies")
    rest = texts.join(F.broadcast(heavy), key, "left_anti").join(copies.where(F.col("copies") * HEAVY < n), key, "left")
    out = rest.unionByName(hot, allowMissingColumns=True).withColumn("alone", F.col("copies").isNull())
    # a text with copies is removed as a whole or too short to be cut, so only single ones need the cut
    single = out.where("alone").join(cut, key, "left")
    out = single.unionByName(out.where("not alone"), allowMissingColumns=True)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = F.lit(b"")

    def chosen(all_of_it, name, none):
        return F.when(whole, all_of_it).otherwise(F.coalesce(F.col(name), none)).alias(name)

    return out.select(
        "doc_id",
        "n_bytes",
        chosen(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")),
        chosen(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
        chosen(F.sha2(empty, 256), "kept_sha256", F.lower(F.hex("digest"))),
        F.when(whole, empty).otherwise(F.col("kept")).alias("kept"),
    )
