"""Words and their hashes for whole Arrow batches, in numpy.

Texts are handled as UTF-8 bytes of many documents at once, in slices of about
``SLICE_BYTES`` (a longer text is a slice of its own), so that the work per
document is small and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_tables(separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is it part of a word, its lower case, a random 64-bit value of that."""
    byte = np.arange(256, dtype=np.uint64)
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    lower = byte.astype(np.uint8)
    lower[65:91] += 32
    return inside, lower, mixed(lower.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


PUNCTUATION_TOO = bytes(i for i in range(128) if not chr(i).isalnum())


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class WordSlices:
    """Cuts text columns into slices of ``most`` bytes or one text, with words; keeps its tables between batches."""

    def __init__(self, separators: bytes = SPACES, most: int = SLICE_BYTES):
        self.most = most
        self.inside, self.lower, self.value = byte_tables(separators)
        self.up = self.down = np.empty(0, np.uint64)

    def slices(self, column: pa.Array) -> Iterator[Slice]:
        """The column's texts with their words."""
        for piece in byte_slices(column, self.most):
            yield self._words(piece)

    def _words(self, piece: Slice) -> Slice:
        data, offsets, n = piece.data, piece.offsets, len(piece.data)
        if n > len(self.up):
            size = max(n, 2 * self.most)
            self.up, self.down = powers(size + 1, _MULTIPLIER), powers(size + 1, _INVERSE)
        inside = self.inside[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=total[1:])
        hashes = mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))
        word_of = np.searchsorted(start, offsets)  # first word of each document
        return Slice(data, offsets, piece.first, start, end, hashes, word_of)


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts, null as empty, without words, in slices of ``most`` bytes or one text."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


class Slice:
    """Documents ``first`` and on of a batch: their bytes and words."""

    def __init__(self, data, offsets, first, start=None, end=None, hashes=None, word_of=None):
        self.data, self.offsets, self.first = data, offsets, first
        self.start, self.end, self.hashes, self.word_of = start, end, hashes, word_of
        self.n = len(offsets) - 1

    def shingle_sets(self, width: int) -> Iterator[np.ndarray]:
        """Per document the sorted distinct hashes of its runs of ``width`` words.

        Fewer words make one run of all of them; no words make an empty set.
        """
        h, base = self.hashes, np.uint64(0xD6E8FEB86659FD93)
        runs = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            runs = runs * base + h[k : k + len(runs)]
        runs = mixed(runs)
        for a, b in zip(self.word_of[:-1].tolist(), self.word_of[1:].tolist(), strict=True):
            if b - a >= width:
                yield unique(runs[a : b - width + 1])
            elif b > a:
                short = b - a
                for x in h[a:b].tolist():
                    short = (short * int(base) + x) & 0xFFFFFFFFFFFFFFFF
                yield mixed(np.array([short], np.uint64))
            else:
                yield runs[:0]


def unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
