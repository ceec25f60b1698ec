"""Sets of word shingles as sorted 64-bit hashes, and their signatures for a similarity join."""

from __future__ import annotations

import math

import numpy as np
import xxhash

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
CACHE = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Hashes of words, kept while there are few."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_set(text: bytes, words: Words, width: int = 4) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text in ASCII lower case.

    A text with fewer words than a shingle has its whole sequence as the one shingle; without words there is none.
    """
    found = text.lower().split()  # for bytes: A-Z only, and these six spaces only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    k = min(width, len(h))
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total = mix(total + h[i : i + n] * MULTIPLIERS[i % 8] + np.uint64(i // 8))
    return np.unique(total)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a, b = mix(found).sum(dtype=np.uint64), mix(found ^ MULTIPLIERS[0]).sum(dtype=np.uint64)
    n = np.uint64(len(found))
    return tuple(mix(np.array([a + n, b ^ n], np.uint64)).view(np.int64).tolist())


class Schemes:
    """Size bands and what each one asks for, for a Jaccard threshold of percent / 100.

    Sets of sizes s and t are similar only if their symmetric difference is at most
    (s + t) (100 - percent) / (100 + percent). A band [low, high) cuts the universe of hashes into m segments, m above
    the largest difference in the band by a quarter; bands overlap so that any similar pair has a band in common.
    """

    def __init__(self, percent: int = 85, ratio: float = 1.7) -> None:
        self.percent, self.ratio, self.bands = percent, ratio, [(1, 8)]

    def difference(self, total: int) -> int:
        return total * (100 - self.percent) // (100 + self.percent)

    def partner(self, size: int) -> int:
        return size * 100 // self.percent

    def segments(self, high: int) -> int:
        h = self.difference(2 * (high - 1))
        return h + 1 + (h + 1) // 4

    def of(self, size: int) -> list[tuple[int, int]]:
        """Number and segments of each band that holds the size."""
        while self.bands[-1][0] <= size:
            low = max(self.bands[-1][0] + 1, self.bands[-1][1] * self.percent // 100)
            self.bands.append((low, max(math.ceil(low * self.ratio), self.partner(low) + 2)))
        return [(k, self.segments(high)) for k, (low, high) in enumerate(self.bands) if low <= size < high]


def bounds(found: np.ndarray, schemes: Schemes) -> list[tuple[int, int]]:
    """(list, least) of each list of a set's signatures, without the signatures."""
    out = []
    for band, m in schemes.of(len(found)):
        h = schemes.difference(len(found) + schemes.partner(len(found)))
        several = int((_sizes(found, m)[1] > 1).sum())
        out.append((2 * band, max(several - h, 1)))
        if several <= h:
            out.append((2 * band + 1, 1))
    return out


def _sizes(found: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the m segments of a sorted set begin and end, and their sizes."""
    segment = ((found >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ranges of hashes: found is sorted
    edges = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    return edges, np.diff(edges)


def signatures(found: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Signatures of a set, and (list, least) of each list of them; the low byte of a signature is its list.

    In a band, segments of two similar sets differ in at most H of m places. Segments with one shingle or none are
    shared by many sets and dear; the others are indexed. A set with d dear segments then shares at least m - H - d
    indexed ones with any similar set; this is the list's `least`. Where it isn't positive, the set allots two units of
    difference to each segment of two shingles or more, by the segment and all its one-deletion neighbours (a list of
    its own), which finds any other such set, provided that more than H / 2 segments have three or more; only where
    that fails too, the dear segments are indexed as well.
    """
    n = len(found)
    out, least = [], []
    values = mix(found ^ MULTIPLIERS[2])
    ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    for band, m in schemes.of(n):
        h = schemes.difference(n + schemes.partner(n))
        edges, size = _sizes(found, m)
        total = ahead[edges[1:]] - ahead[edges[:-1]]
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        several = np.flatnonzero(size > 1)
        sure = len(several) - h
        out.append(_listed(mix(total[several] + tag[several]), 2 * band))
        least.append((2 * band, max(sure, 1)))
        if sure > 0:
            continue
        near = mix(tag + MULTIPLIERS[3])
        where = np.repeat(np.arange(m), size)
        wide = size[where] > 2
        more = [mix(total[several] + near[several]), mix(total[where[wide]] - values[wide] + near[where[wide]])]
        if (size > 2).sum() <= h // 2:
            dear = np.flatnonzero(size < 2)
            more.append(mix(total[dear] + tag[dear]))
        out.append(_listed(np.concatenate(more), 2 * band + 1))
        least.append((2 * band + 1, 1))
    return (np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)), least


def _listed(hashes: np.ndarray, number: int) -> np.ndarray:
    return hashes & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(number)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a & b| >= percent |a | b|, for sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
