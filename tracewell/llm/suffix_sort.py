"""Suffix arrays by induced sorting, in numpy, for one shard of bytes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The
leftmost S suffixes of each run (LMS) are sorted first: their substrings by one
induction, named, and the string of names by ranks that double in reach. From
their order all L suffixes are induced from left to right, then all S suffixes
from right to left, bucket by bucket: everything that a bucket induces is
placed by array operations at once.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last, a unique least symbol, is."""
    ends = np.flatnonzero(t[:-1] != t[1:])
    less = t[ends] < t[ends + 1]
    out = np.empty(len(t), bool)
    out[: len(t) - 1] = np.repeat(less, np.diff(np.concatenate(([-1], ends))))
    out[-1] = True
    return out


def _spread(parts, t, pred, c):
    """Deal ``pred`` to the parts of their symbols; gives back those of symbol ``c``."""
    if not len(pred):
        return pred
    symbol = t[pred]
    order = np.argsort(symbol, kind="stable")
    pred, symbol = pred[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    same = pred[:0]
    for piece in np.split(pred, cuts):
        d = int(t[piece[0]])
        if d == c:
            same = piece
        else:
            parts[d].append(piece)
    return same


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from ``lms`` in their order (within each symbol)."""
    symbols = np.flatnonzero(np.bincount(t)).tolist()
    none = np.empty(0, np.int64)
    order = lms[np.argsort(t[lms], kind="stable")]
    cuts = np.searchsorted(t[order], symbols + [symbols[-1] + 1])
    seeds = {c: order[cuts[k] : cuts[k + 1]] for k, c in enumerate(symbols)}
    large: dict[int, list] = {c: [] for c in symbols}
    done: dict[int, np.ndarray] = {}
    for c in symbols:
        now = np.concatenate(large[c]) if large[c] else none
        waves = []
        while len(now):
            waves.append(now)
            pred = now[now > 0] - 1
            now = _spread(large, t, pred[~s[pred]], c)
        done[c] = np.concatenate(waves) if waves else none
        pred = seeds[c]
        pred = pred[pred > 0] - 1
        _spread(large, t, pred[~s[pred]], c)
    small: dict[int, list] = {c: [] for c in symbols}
    out = []
    for c in reversed(symbols):
        now = np.concatenate(small[c]) if small[c] else none
        waves = []
        while len(now):
            waves.append(now)
            pred = now[now > 0] - 1
            now = _spread(small, t, pred[s[pred]], c)
        out += waves
        pred = done[c][::-1]
        out.append(pred)
        pred = pred[pred > 0] - 1
        _spread(small, t, pred[s[pred]], c)
        if c == symbols[0]:  # the last symbol is induced by none
            out.append(np.array([len(t) - 1]))
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of ``t`` in the order of their suffixes.

    The last symbol must be the least and occur once. With ``depth`` the order
    is certain for that many symbols only.
    """
    # symbols of 16 bits are sorted by radix
    t = t.astype(np.int16 if t.max() < 1 << 15 else np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    s = s_types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        lms = lms[_lms_order(t, s, lms, depth)]
    return induce(t, s, lms)


def _lms_order(t, s, lms, depth) -> np.ndarray:
    """The order of the LMS suffixes, as places in ``lms``."""
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    by_substring = place[induce(t, s, lms)]
    by_substring = by_substring[by_substring >= 0]
    size = np.diff(np.concatenate((lms, [len(t) - 1])))
    fresh = np.ones(len(lms), bool)
    fresh[1:] = ~_equal(t, lms[by_substring[:-1]], lms[by_substring[1:]], size[by_substring[:-1]], size[by_substring[1:]])
    rank = np.empty(len(lms), np.int64)
    rank[by_substring] = np.cumsum(fresh) - 1
    reach = 1
    # a substring holds two symbols of its own at least
    while rank.max() < len(lms) - 1 and (depth is None or 2 * reach < depth):
        after = np.zeros(len(lms), np.int64)
        after[:-reach] = rank[reach:] + 1
        key = rank * (len(lms) + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        reach *= 2
    return np.argsort(rank, kind="stable")


def _equal(t, a, b, size_a, size_b) -> np.ndarray:
    """Are the substrings at a and b, with the symbol after them, the same?"""
    same = size_a == size_b
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = t[np.minimum(x, len(t) - 1)] == t[np.minimum(y, len(t) - 1)]
        same[live[~equal]] = False
        live = live[equal]
        live = live[size_a[live] > k]
        k += 1
    return same


def permuted_prefixes(t: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By place in ``t``: the suffix before it in ``order`` (-1: none), and do both share ``least`` symbols?

    The comparison runs in the order of the text, by prefix sums of hashed symbols.
    """
    before = np.full(len(t), -1, np.int64)
    before[order[1:]] = order[:-1]
    power = np.full(len(t) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(_hashed(t) * power[:-1], out=total[1:])
    window = total[least:] - total[: len(total) - least]  # times power[place]
    here = np.arange(len(t))
    fits = (before >= 0) & (np.maximum(here, before) + least <= len(t))
    x, y = here[fits], before[fits]
    # bring both windows to the same power
    low, high = np.minimum(x, y), np.maximum(x, y)
    shared = np.zeros(len(t), bool)
    shared[fits] = window[low] * power[high - low] == window[high]
    return before, shared


def _hashed(t: np.ndarray) -> np.ndarray:
    x = t.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))
