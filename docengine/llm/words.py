"""Whole texts as arrays of 64-bit word hashes, computed on flat UTF-8 bytes.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return; A-Z are lower-cased.
"""

from __future__ import annotations

import numpy as np

from .common import process_cache

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes up to which the powers of the base are kept from call to call.
KEPT = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n or more; one table serves all tasks of a process."""
    kept = process_cache()
    have = kept.get("powers")
    if have is None or len(have[0]) < n:
        have = []
        for base in (BASE, BASE_INV):
            p = np.full(max(n, 1), base, np.uint64)
            p[0] = 1
            have.append(np.multiply.accumulate(p))
        if n <= KEPT:
            kept["powers"] = have
    return have[0], have[1]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the index of each document's first word (one entry more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    blank = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1] | edge[1:-1]
    end[:-1] &= blank[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, start): a hash of each lower-cased word, each document's first word, each word's first byte."""
    s, e, first = word_spans(data, off)
    if not len(s):
        return np.zeros(0, np.uint64), first, s
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER[data] * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64)), first, s


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of k-word shingles, offsets by document); a text of fewer words is one shingle as a whole."""
    n = len(first) - 1
    if len(h) >= k:
        roll = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            roll = roll * BASE + h[j : len(h) - k + 1 + j]
        roll = mix(roll + np.uint64(k))
    else:
        roll = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(n + 1, np.int64)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            u = np.unique(roll[a : b - k + 1])
        elif b > a:
            v = np.uint64(b - a)
            for x in h[a:b]:
                v = np.uint64((int(v) * int(BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            u = mix(np.array([v], np.uint64) + np.uint64(1 << 40))
        else:
            continue
        out.append(u)
        sizes[d + 1] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
