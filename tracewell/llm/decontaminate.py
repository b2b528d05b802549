"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts are compared as words in lower case with one space between, punctuation
out. In every document item-sized windows are laid so that a word of the item
(one of its anchors) stands where the item has it. An item has as many anchors as
it takes until hardly an edited copy loses them all. A CGK random walk embeds windows and items, from the anchor towards the
farther end: it reads a symbol, writes it, and a random bit of that symbol and
step says whether to move on. Texts a few edits apart get embeddings that agree
in many places, so windows that agree with the item in a few sampled places are
candidates; sampling is repeated, with several walks, as often as the target
recall asks (measured on copies of items that are edited everywhere, anchors too).
Items with too few words for that are cut into one piece more than edits are
allowed, one of which every copy still has; windows are laid where a piece occurs.
Every candidate is then checked by exact edit distance, wherever it begins or
ends around its window.

Copies with no edit are always found, and ``RECALL`` of those with random edits
up to ``MAX_EDITS`` of the item's length. The benchmark is sent to tasks in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters; every block meets all rows.

Cases: null or empty texts hold nothing; items without words are never found;
equal items are found each; documents that repeat are found each; one row per
(document row, item), the closest place, first of ties. A text of any length is
read in slices. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import PUNCTUATION_TOO, WordSlices, mixed
from tracewell.operators.sizes import landed, small_batches

MAX_EDITS = 0.15
RECALL = 0.95
ANCHORS_LOST = 0.2  # of the loss that RECALL allows, so much may come from copies without an anchor
RARE = 1e-6  # words of at most this share of the corpus are equally good anchors
RARE_LEAST = 20
PIECE = 8  # bytes of a piece that are looked up
COPIES = 512  # edited copies on which recall is measured
GRAM = 4  # one edit changes so many grams of this length
WALKS = 4
BITS = 4
NEAR, REACH = 0.12, 0.6  # places are sampled between these shares of a ray
WINDOWS = 32768  # embedded at a time
MAX_REPEATS = 256
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 4_000_000
COUNTED, SEARCHED = 1 << 18, 1 << 19  # bytes of text that a task counts words in or searches at once
TOTAL = (1 << 64) - 1  # stands for all words among their hashes
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
SCHEMA = "doc_id long, item_id long, start_char int, end_char int, edits int, item_length int"


def plain(text: str) -> bytes:
    """Words in lower case (A-Z), one space between, UTF-8."""
    return b" ".join(m[0].encode() for m in WORD.finditer(text)).lower()


def _walk_bits(steps: int, seed: int) -> np.ndarray:
    """Does a walk move on? By step and symbol."""
    return (mixed(np.arange(256 * steps, dtype=np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(np.int64)


def cgk(texts: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The walk's output for each row of padded ``texts``: ``steps`` symbols, 0 past the end."""
    place = np.zeros(len(texts), np.int64)
    out = np.zeros((steps, len(texts)), np.uint8)
    rows = np.arange(len(texts))
    bits = _walk_bits(steps, seed).reshape(steps, 256)
    wide = np.column_stack([texts, np.zeros(len(texts), np.uint8)])
    for step in range(steps):
        symbol = wide[rows, np.minimum(place, lengths)]
        out[step] = symbol
        place += bits[step, symbol]
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    flat = np.frombuffer(bytearray().join(t.ljust(width, b"\0") for t in texts), np.uint8) if width else np.empty(0, np.uint8)
    return flat.reshape(len(texts), width), lengths


@dataclass(frozen=True)
class Item:
    item_id: int
    text: bytes
    anchors: tuple[tuple[int, int, int], ...]  # (hash, first byte, byte after) of words in the text; none: by pieces

    def ray(self, start: int, end: int) -> tuple[bool, bytes]:
        """Is the farther end ahead of an anchor? What is read from the anchor to there."""
        if start + end <= len(self.text):
            return True, self.text[start:]
        return False, self.text[:end][::-1]


def edited(text: bytes, edits: int, random: np.random.Generator) -> tuple[bytes, list[int]]:
    """A copy with so many random edits, and of each byte its place in ``text`` (-1: new)."""
    letters = np.frombuffer(b"etaoinshrdlu ", np.uint8)
    changed = [(c, k) for k, c in enumerate(text)]
    for _ in range(edits):
        k, kind = int(random.integers(len(changed))), random.integers(3)
        if kind == 0:
            changed[k] = (int(random.choice(letters)), -1)
        elif kind == 1 and len(changed) > 1:
            del changed[k]
        else:
            changed.insert(k, (int(random.choice(letters)), -1))
    return bytes(c for c, _ in changed), [k for _, k in changed]


def _rays_left(item: Item, copy: bytes, origin: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """The item's ray and the copy's, of each anchor that the copy still has as a word."""
    at = {place: k for k, place in enumerate(origin)}
    for _, start, end in item.anchors:
        a = at.get(start, -1)
        b = a + end - start
        if a < 0 or origin[a:b] != list(range(start, end)):
            continue
        if (a and copy[a - 1] != 32) or (b < len(copy) and copy[b] != 32):
            continue
        ahead, ray = item.ray(start, end)
        yield ray, copy[a:] if ahead else copy[:b][::-1]


def sampling(
    items: list[Item], max_edits: float = MAX_EDITS, recall: float = RECALL, bits: int = BITS
) -> list[tuple[int, tuple[float, ...]]] | None:
    """(walk, sampled places as shares of the walk) for as many repeats as recall asks.

    Copies of up to 64 items are edited at the limit, anchors too; the walks from
    the anchors left are compared with the items' own, and repeats added until
    ``recall`` of the copies agree in one. Where MAX_REPEATS are too few, fewer
    bits are sampled; None if that is not enough either.
    """
    random = np.random.default_rng(7)
    some = items[:: max(1, len(items) // 64)][:64]
    mine, theirs, whose = [], [], []
    n_copies = len(some) * max(1, COPIES // max(1, len(some)))
    for k in range(n_copies):
        item = some[k % len(some)]
        for ray, other in _rays_left(item, *edited(item.text, int(max_edits * len(item.text)), random)):
            mine.append(ray)
            theirs.append(other)
            whose.append(k)
    if not mine:
        return None if some else []
    whose, n = np.array(whose), np.array([len(t) for t in mine])
    steps, rows = int(n.max() * REACH) + 1, np.arange(len(mine))
    same = []
    for walk in range(WALKS):
        same.append(cgk(*padded(mine), steps, walk) == cgk(*padded(theirs), steps, walk))
    for some_bits in range(bits, 0, -1):
        found, out = np.zeros(n_copies, bool), []
        while found.mean() < recall and len(out) < MAX_REPEATS:
            walk = len(out) % WALKS
            # not too near to the anchor, where all agree, nor at the end, where few do
            places = tuple(float(x) for x in np.sort(NEAR + random.random(some_bits) * (REACH - NEAR)))
            hit = np.ones(len(mine), bool)
            for p in places:
                hit &= same[walk][(p * n).astype(np.int64), rows]
            found[whose[hit]] = True
            out.append((walk, places))
        if found.mean() >= recall:
            return out
    return None


def edit_match(pattern: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the closest substring of ``text``, first end on ties; None over ``limit``.

    Bit-parallel dynamic programming, exact: one machine word per column of any height.
    """
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    edits, end = _closest_end(pattern, text, limit)
    if edits > limit:
        return None
    _, back = _closest_end(pattern[::-1], text[:end][::-1], limit, anchored=True)
    return edits, end - back, end


def _closest_end(pattern: bytes, text: bytes, limit: int, anchored: bool = False) -> tuple[int, int]:
    m = len(pattern)
    top, mask = 1 << (m - 1), (1 << m) - 1
    where: dict[int, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | ~(d | plus) & mask
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = h_plus << 1 | anchored
        h_minus <<= 1
        plus = (h_minus | ~(x | h_plus)) & mask
        minus = h_plus & x & mask
        if score < best:
            best, end = score, k + 1
    return best, end


def _anchors(
    words: list[tuple[int, int, int]], counts: dict[int, int], rare: float, size: int, edits: int, lost: float
) -> tuple[tuple[int, int, int], ...]:
    """Words of an item of ``size`` bytes, until at most ``lost`` of its copies with so many edits lack them all.

    None if its words are too few. Words that the corpus has not can lead
    nowhere. Rarer words come first by the size of their counts only: among many
    verbatim copies and an edited one, the least count is of the words that the
    edited copy has lost.
    """
    ordered = []
    for h, start, end in words:
        if n := counts.get(h, 0):
            luck = int(mixed(np.array([h ^ start], np.uint64))[0]) / 2**64
            # bounds of size that are each word's own, so that no step separates counts that are nearly equal
            ordered.append((math.floor(math.log2(max(n, rare)) + luck), luck * 997 % 1, h, start, end))
    if not edits:
        return tuple(w[2:] for w in sorted(ordered)[:1])
    chosen, none_left = [], 1.0
    for *_, h, start, end in sorted(ordered):
        chosen.append((h, start, end))
        # an edit spoils a word inside it and at the separators around it
        none_left *= 1 - max(0.0, 1 - (end - start + 2) / size) ** edits
        if none_left <= lost:
            return tuple(chosen)
    return ()


def _pieces(size: int, edits: int) -> tuple[int, list[int]]:
    """Bytes and places of one disjoint piece more than edits, so that one is whole in every copy."""
    step = size // (edits + 1)
    return min(PIECE, step), [k * step for k in range(edits + 1)] if step else []


def _anchor_counts(wanted: np.ndarray):
    """Counts the words with ``wanted`` hashes (sorted) in a task's texts, and all words as TOTAL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total, words = WordSlices(PUNCTUATION_TOO, COUNTED), np.zeros(len(wanted), np.int64), 0
        seen = _Members(wanted)
        for batch in batches:
            for s in cut.slices(batch.column("text")):
                _, which = seen.of(s.hashes)
                total += np.bincount(which, minlength=len(wanted))
                words += len(s.hashes)
        some = np.flatnonzero(total)
        h = np.append(wanted[some], np.uint64(TOTAL)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.append(total[some], words))], ["h", "n"])

    return run


class _Members:
    """Which of many hashes are in a small sorted set: a bit table first, then a search."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.table = np.zeros(1 << 20, bool)
        self.table[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of members, and of each its place in the set."""
        maybe = np.flatnonzero(self.table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.wanted):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(self.wanted, hashes[maybe]), len(self.wanted) - 1)
        real = self.wanted[k] == hashes[maybe]
        return maybe[real], k[real]


def _item_words(text: bytes) -> list[tuple[int, int, int]]:
    """(hash, first byte, byte after) of every word."""
    s = next(WordSlices(PUNCTUATION_TOO).slices(pa.array([text.decode()])))
    return list(zip(s.hashes.tolist(), s.start.tolist(), s.end.tolist(), strict=True))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    block, chars = [], 0
    rows = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null and item_id is not null")
    for row in rows.toLocalIterator():
        if text := plain(row.text):
            block.append((row.item_id, text))
            chars += len(text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _codes(flat: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` bytes in a row, up to eight."""
    codes = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        codes = codes << np.uint64(8) | flat[k : k + len(codes)]
    return mixed(codes)


class _Search:
    """Finds a block of items in a task's texts."""

    def __init__(self, items: list[Item], repeats, max_edits: float):
        self.items, self.repeats, self.max_edits = items, repeats, max_edits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self._prepare()
        for batch in batches:
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for s in self.cut.slices(batch.column("text")):
                flat, windows = self._windows(s, best)
                for at in range(0, len(windows), WINDOWS):
                    self._check(flat, windows[at : at + WINDOWS], best)
            yield self._found(best, batch)

    def _prepare(self) -> None:
        self.cut = WordSlices(PUNCTUATION_TOO, SEARCHED)
        self.sizes = np.array([len(i.text) for i in self.items], np.int64)
        self.limits = (self.max_edits * self.sizes).astype(np.int64)
        self.grams = [[i.text[k : k + GRAM] for k in range(len(i.text) - GRAM + 1)] for i in self.items]
        self.pieces = self._piece_tables()
        pairs = sorted((h, k, a, b) for k, item in enumerate(self.items) for h, a, b in item.anchors)
        hashes = np.array([h for h, *_ in pairs], np.uint64)
        # for each anchor word the run of pairs (item, place) that it stands for
        wanted, self.first = np.unique(hashes, return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.members = _Members(wanted)
        self.item = np.array([k for _, k, _, _ in pairs], np.int64)
        self.at = np.array([a for _, _, a, _ in pairs], np.int64)
        rays = [self.items[k].ray(a, b) for _, k, a, b in pairs]
        self.ahead = np.array([ahead for ahead, _ in rays], bool)
        texts, self.reach = padded([text for _, text in rays])
        self.steps = int(self.reach.max(initial=0) * REACH) + 1
        self.walks = []
        for walk in {w for w, _ in self.repeats}:
            asked = [places for w, places in self.repeats if w == walk]
            # (share of the ray, repeat, is it the repeat's last place?) along the walk
            stops = sorted((p, k, p == max(places)) for k, places in enumerate(asked) for p in places)
            own = cgk(texts, self.reach, self.steps, walk)
            self.walks.append((own, _walk_bits(self.steps, walk), stops, len(asked)))

    def _piece_tables(self):
        """By piece length: the pieces' hashes and for each its run of (item, place)."""
        found = defaultdict(list)
        for k, item in enumerate(self.items):
            if not item.anchors:
                size, places = _pieces(len(item.text), int(self.limits[k]))
                for at in places:
                    codes = _codes(np.frombuffer(item.text[at : at + size], np.uint8), size)
                    found[size].append((int(codes[0]), k, at))
        tables = []
        for size, rows in sorted(found.items()):
            rows.sort()
            wanted, first = np.unique(np.array([h for h, *_ in rows], np.uint64), return_index=True)
            tables.append((size, _Members(wanted), np.append(first, len(rows)), [(k, at) for _, k, at in rows]))
        return tables

    def _by_pieces(self, s, flat, where, best) -> None:
        """Checks around every piece that occurs in a slice."""
        begins = where[s.offsets]
        for size, members, first, rows in self.pieces:
            place, which = members.of(_codes(flat, size))
            doc = np.searchsorted(begins, place, "right") - 1
            for p, piece, d in zip(place.tolist(), which.tolist(), doc.tolist(), strict=True):
                low, high = int(begins[d]), int(begins[d + 1])
                if p + size > high:
                    continue
                for k, at in rows[first[piece] : first[piece + 1]]:
                    if high - low >= self.sizes[k] - self.limits[k]:
                        self._verify(flat, d + s.first, low, high, k, p - at, best)

    def _windows(self, s, best):
        """The plain bytes of a slice, and (document, its low and high byte, pair, anchor's place) of windows.

        Items that go by pieces are checked at once.
        """
        word, which = self.members.of(s.hashes)
        if not len(word) and not self.pieces:
            return np.empty(0, np.uint8), np.empty((0, 6), np.int64)
        inside = self.cut.inside[s.data]
        space = np.zeros(len(s.data), bool)
        after = s.end[s.end < len(s.data)]
        space[after] = ~inside[after]
        # words and one separator each; a document's last word may have none
        keep = inside | space
        flat = np.where(space, np.uint8(32), self.cut.lower[s.data])[keep]
        where = np.concatenate(([0], np.cumsum(keep)))
        if self.pieces:
            self._by_pieces(s, flat, where, best)
        count = self.first[which + 1] - self.first[which]
        pair = np.arange(count.sum()) + np.repeat(self.first[which] - (np.cumsum(count) - count), count)
        word = np.repeat(word, count)
        doc = np.searchsorted(s.word_of, word, "right") - 1
        low, high = where[s.offsets[doc]], where[s.offsets[doc + 1]]
        # a document smaller than the item less the edits cannot hold it
        item = self.item[pair]
        fits = high - low >= self.sizes[item] - self.limits[item]
        columns = (doc + s.first, low, high, pair, where[s.start[word]], where[s.end[word] - 1] + 1)
        return flat, np.column_stack(columns)[fits]

    def _check(self, flat, windows, best) -> None:
        picked = self._agreeing(flat, windows)
        for doc, low, high, pair, start, _ in windows[picked].tolist():
            self._verify(flat, doc, low, high, int(self.item[pair]), start - int(self.at[pair]), best)

    def _agreeing(self, flat, windows) -> np.ndarray:
        """Which windows agree with their item in all places of a repeat?

        A window is walked only as long as some repeat has agreed so far.
        """
        _, low, high, pair, start, end = windows.T
        ahead, reach = self.ahead[pair], self.reach[pair]
        base, sign = np.where(ahead, start, end - 1), np.where(ahead, 1, -1)
        last = np.minimum(reach, np.where(ahead, high - start, end - low)) - 1
        picked = np.zeros(len(pair), bool)
        for own, bits, stops, n_repeats in self.walks:
            rows = np.flatnonzero(~picked)
            agreed = np.ones((n_repeats, len(rows)), bool)
            place, step = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for p, k, is_last in stops:
                stop = (p * reach[rows]).astype(np.int64)
                order = np.argsort(step - stop, kind="stable")  # those with most steps to go first
                rows, agreed, place, step, stop = rows[order], agreed[:, order], place[order], step[order], stop[order]
                to_go, b, d, e = stop - step, base[rows], sign[rows], last[rows]
                for done in range(int(to_go.max(initial=0))):
                    n = int(np.searchsorted(-to_go, -done, "left"))
                    now = place[:n]
                    symbol = np.where(now <= e[:n], flat[b[:n] + d[:n] * np.minimum(now, e[:n])], np.uint8(0))
                    now += bits[(step[:n] + done) * 256 + symbol]
                symbol = np.where(place <= e, flat[b + d * np.minimum(place, e)], np.uint8(0))
                agreed[k] &= symbol == own[stop, pair[rows]]
                if is_last:
                    picked[rows[agreed[k]]] = True
                    agreed[k] = False
                some = agreed.any(axis=0) & ~picked[rows]
                rows, agreed, place, step = rows[some], agreed[:, some], place[some], stop[some]
        return picked

    def _verify(self, flat, doc, low, high, k, start, best) -> None:
        """Exact edit distance around a window; keeps the best place of each document and item."""
        if best.get((doc, k), (1,))[0] == 0:
            return
        limit = int(self.limits[k])
        slack = limit + 8
        a, b = max(low, start - slack), min(high, max(low, start) + int(self.sizes[k]) + slack)
        text = flat[a:b].tobytes()
        # a match within the limit leaves so many of the item's grams whole
        if self.grams[k]:
            there = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
            if sum(g in there for g in self.grams[k]) < len(self.grams[k]) - GRAM * limit:
                return
        if m := edit_match(self.items[k].text, text, limit):
            new = (m[0], a - low + m[1], a - low + m[2])
            best[doc, k] = min(best.get((doc, k), new), new)

    def _found(self, best, batch) -> pa.RecordBatch:
        out = []
        ids, texts = batch.column("doc_id"), batch.column("text")
        for (doc, k), (edits, a, b) in sorted(best.items()):
            begin, end = _places(texts[doc].as_py(), a, b)
            out.append((ids[doc].as_py(), self.items[k].item_id, begin, end, edits, len(self.items[k].text)))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _places(text: str, a: int, b: int) -> tuple[int, int]:
    """Bytes a to b of the plain form as code points of the text itself."""
    at, begin, end = 0, None, len(text)
    for m in WORD.finditer(text):
        size = len(m[0].encode())
        if begin is None and at + size > a:
            begin = m.start() + len(m[0].encode()[: max(0, a - at)].decode(errors="ignore"))
        if at + size >= b:
            end = m.start() + len(m[0].encode()[: max(0, b - at)].decode(errors="ignore"))
            break
        at += size + 1
    return begin or 0, end


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL
) -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits, item_length of every find.

    Places are code points of the document's text. Starts two jobs a block.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    parts = []
    for block in _blocks(benchmark):
        words = {item: _item_words(text) for item, (_, text) in enumerate(block)}
        wanted = np.array(sorted({w[0] for found in words.values() for w in found}), np.uint64)
        counts = rows.select("text").mapInArrow(_anchor_counts(wanted), "h long, n long")
        counts = {h % (1 << 64): n for h, n in counts.groupBy("h").agg(F.sum("n")).collect()}
        total = counts.pop(TOTAL, 0)
        items, rare, lost = [], max(RARE_LEAST, RARE * total), ANCHORS_LOST * (1 - recall)
        for k, (item_id, text) in enumerate(block):
            edits = int(max_edits * len(text))
            anchors = _anchors(words[k], counts, rare, len(text), edits, lost)
            if not anchors and not edits:
                continue  # nowhere in the corpus
            items.append(Item(item_id, text, anchors))
        repeats = sampling([i for i in items if i.anchors], max_edits, recall)
        if repeats is None:
            # no sampling is good enough: all by pieces
            items, repeats = [Item(i.item_id, i.text, ()) for i in items], []
        parts.append(rows.mapInArrow(_Search(items, repeats, max_edits), SCHEMA))
    if not parts:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without those in which an item was found. Rows are told by a hash of their text, so doc_id may be null."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    with small_batches(docs.sparkSession):
        found = benchmark_matches(docs.select(text.alias("doc_id"), "text"), benchmark, **settings)
        found = landed(found.select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(found, text == found["__leak"], "left_anti")
