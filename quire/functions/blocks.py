"""Matching blocks of two texts, longest first, and how much of one text's runs another has, without comparing every pair of places."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

from .literal import occurrences

#: Pairs of places up to which two stretches are compared directly.
FEW = 20_000


class _Stretches:
    """Classes of equal stretches of 2 ** k characters of both texts, for each k at which both have some in common."""

    def __init__(self, a: str, b: str):
        both = np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (a, b)])
        self.n = len(a)
        classes = np.unique(both, return_inverse=True)[1].astype(np.int64)
        # a text's last stretches are short: each place too near the end is in no class
        ends = np.concatenate([np.full(len(a), len(a)), np.full(len(b), len(a) + len(b))])
        places = np.arange(len(both))
        self.levels: list[np.ndarray] = []
        size = 1
        while True:
            whole = places + size <= ends
            at_a, at_b = classes[: self.n][whole[: self.n]], classes[self.n :][whole[self.n :]]
            mark = np.zeros(int(classes.max(initial=-1)) + 2, dtype=bool)
            mark[at_a] = True
            if not len(at_b) or not mark[at_b].any():
                return
            self.levels.append(np.where(whole, classes, -1).astype(np.int32))
            ahead = np.full(len(both), -1, dtype=np.int64)
            ahead[: len(both) - size] = self.levels[-1][size:]
            good = (self.levels[-1] >= 0) & (ahead >= 0) & (places + 2 * size <= ends)
            key = self.levels[-1][good].astype(np.int64) * (len(both) + 1) + ahead[good]
            classes = np.full(len(both), -1, dtype=np.int64)
            classes[good] = np.unique(key, return_inverse=True)[1]
            size *= 2

    def longest(self, a_low: int, a_high: int, b_low: int, b_high: int, level: int) -> tuple[int, int, int, int]:
        """(begin in a, begin in b, length, level of the length): the first longest block; length 0 if there is none."""
        level = min(level, len(self.levels) - 1, min(a_high - a_low, b_high - b_low).bit_length() - 1)
        while level >= 0:
            size = 1 << level
            own, other = self.levels[level][a_low : a_high - size + 1], self.levels[level][self.n + b_low : self.n + b_high - size + 1]
            mark = np.zeros(int(max(own.max(initial=0), other.max(initial=0))) + 1, dtype=bool)
            mark[own] = True
            there = np.flatnonzero(mark[other])
            if len(there):
                mark[:] = False
                mark[other[there]] = True
                return *self._grown(np.flatnonzero(mark[own]) + a_low, there + b_low, level, a_high, b_high), level
            level -= 1
        return a_low, b_low, 0, 0

    def _grown(self, i: np.ndarray, j: np.ndarray, level: int, a_high: int, b_high: int) -> tuple[int, int, int]:
        """Of places that share 2 ** level characters and none twice as many, the first of those that share most.

        The length is found by halving: a stretch of that length is told by its first and its last
        2 ** level characters. Only places that came up to the last length found stay.
        """
        classes, size = self.levels[level], 1 << level
        low, high = size, 2 * size - 1
        while low < high:
            mid = (low + high + 1) // 2
            p, q = i[i + mid <= a_high], j[j + mid <= b_high]
            mine = classes[p].astype(np.int64) << 32 | classes[p + mid - size]
            other = classes[self.n + q].astype(np.int64) << 32 | classes[self.n + q + mid - size]
            keep = np.isin(mine, other)
            if keep.any():
                i, j, low = p[keep], q[np.isin(other, mine[keep])], mid
            else:
                high = mid - 1
        first = int(i.min())
        key = (classes[first], classes[first + low - size])
        q = self.n + j[j + low <= b_high]
        same = (classes[q] == key[0]) & (classes[q + low - size] == key[1])
        return first, int(q[same].min()) - self.n, low


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length): the longest common stretch (the first in a, then in b, of equals), and so on left and right of it.

    The blocks of difflib's SequenceMatcher without its rule for popular characters. Equal stretches are
    found by classes that double in length, so a pair of pages costs n log n and not n * n.
    """
    stretches = _Stretches(a, b)
    waiting, out = [(0, len(a), 0, len(b), len(stretches.levels) - 1)], []
    while waiting:
        a_low, a_high, b_low, b_high, level = waiting.pop()
        if a_low >= a_high or b_low >= b_high or level < 0:
            continue
        if (a_high - a_low) * (b_high - b_low) <= FEW:
            found = SequenceMatcher(None, a[a_low:a_high], b[b_low:b_high], autojunk=False).get_matching_blocks()
            out += [(m.a + a_low, m.b + b_low, m.size) for m in found if m.size]
            continue
        i, j, size, level = stretches.longest(a_low, a_high, b_low, b_high, level)
        if size:
            out.append((i, j, size))
            waiting += [(a_low, i, b_low, j, level), (i + size, a_high, j + size, b_high, level)]
    joined: list[tuple[int, int, int]] = []
    for i, j, size in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + size)
        else:
            joined.append((i, j, size))
    return joined


def likeness(a: str, b: str) -> float:
    """Twice the characters in matching blocks by all characters; 1 for two empty texts."""
    if a == b:
        return 1.0
    return 2.0 * sum(size for _, _, size in matching_blocks(a, b)) / (len(a) + len(b))


#: Characters of a run.
RUN = 8
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(RUN)], dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the run at each place."""
    n = len(points) - RUN + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(RUN if n > 0 else 0):
        out += points[i : i + n].astype(np.uint64) * _FACTORS[i]
    return out


def coverages(contents: list[str], other: str) -> list[float]:
    """For each content the share of its runs that the other content holds; under two runs' length, whether that holds it whole; 1 for an empty one.

    The other content is hashed once, and a run with an equal hash counts when it is the same
    character by character.
    """
    points = _points(other)
    hashes = _hashes(points)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    short = occurrences({c for c in contents if 0 < len(c) < 2 * RUN}, other)
    out = []
    for c in contents:
        if len(c) < 2 * RUN:
            out.append(float(not c or len(short[c]) > 0))
            continue
        own = _points(c)
        h = _hashes(own)
        at, stop = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        found, rows = np.zeros(len(h), dtype=bool), np.flatnonzero(at < stop)
        while len(rows):  # once, but for runs that share a hash
            place = order[at[rows]]
            same = (points[place[:, None] + np.arange(RUN)] == own[rows[:, None] + np.arange(RUN)]).all(axis=1)
            found[rows[same]] = True
            at[rows] += 1
            rows = rows[~same & (at[rows] < stop[rows])]
        out.append(float(found.sum() / len(h)))
    return out
