"""Sorting of many short suffixes by prefix polynomial hashes.

Two suffixes are compared by the length of their common extension, which binary search finds on the
prefix hashes in a logarithmic number of steps; a bottom-up mergesort needs nothing else. All runs of a
level are merged at once: an element's place is its place in its own run plus its rank in the other.
Different hashes prove a difference, equal ones don't prove equality: ``verified`` compares the bytes.
"""

from __future__ import annotations

import numpy as np

from lectern.llm.common import POWERS, prefix_hashes


class Suffixes:
    """Suffix k is data[start[k]:end[k]]; only those of one group, numbered from 0 on in order, compare."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.start, self.end, self.group = data, start.astype(np.int64), end.astype(np.int64), group
        self.prefix = prefix_hashes(data)
        self.down = POWERS.to(len(self.prefix))[1]
        self.base, self.scale = self.prefix[self.start], self.down[self.start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def _agree(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of the first n bytes of suffixes a and b are equal."""
        return (self.prefix[self.start[a] + n] - self.base[a]) * self.scale[a] == (self.prefix[self.start[b] + n] - self.base[b]) * self.scale[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes a and b, as far as hashes tell."""
        out = np.minimum(self.end[a] - self.start[a], self.end[b] - self.start[b])
        rest = np.nonzero(~self._agree(a, b, out))[0]
        a, b, low, high = a[rest], b[rest], np.zeros(len(rest), np.int64), np.maximum(out[rest] - 1, 0)
        for _ in range(int(high.max()).bit_length() if len(rest) else 0):
            mid = (low + high + 1) >> 1
            same = self._agree(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        out[rest] = low
        return out

    def _next(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte of suffix k after its first n, -1 at its end."""
        at = self.start[k] + n
        return np.where(at < self.end[k], self.data[np.minimum(at, len(self.data) - 1)].astype(np.int16), np.int16(-1))

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Negative where suffix a comes before b, 0 where they are equal."""
        n = self.common(a, b)
        return self._next(a, n) - self._next(b, n)

    def sort(self) -> np.ndarray:
        """The suffixes' order: by group, then by bytes; stable."""
        n = len(self.start)
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        first = np.searchsorted(g, g, "left")
        size = np.searchsorted(g, g, "right") - first
        place = np.arange(n) - first
        if n:  # runs of one are merged by one comparison
            left = np.nonzero((place % 2 == 0) & (place + 1 < size))[0]
            swap = left[self.compare(order[left], order[left + 1]) > 0]
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
        width = 2
        while n and width < int(size.max()):
            todo = np.nonzero((size > width) & ((place // (2 * width) * 2 + 1) * width < size))[0]
            base = place[todo] // (2 * width) * 2 * width
            right = place[todo] - base >= width
            begin = np.where(right, base, base + width)  # of the other run
            stop = np.minimum(np.where(right, base + width, base + 2 * width), size[todo])
            low, high = begin + first[todo], stop + first[todo]
            start = low.copy()
            mine = order[todo]
            while len(live := np.nonzero(low < high)[0]):
                mid = (low[live] + high[live]) >> 1
                # From the left run an element passes what is smaller; from the right also what is equal.
                go = self.compare(order[mid], mine[live]) < right[live]
                low[live] = np.where(go, mid + 1, low[live])
                high[live] = np.where(go, high[live], mid)
            rank = low - start
            own = place[todo] - np.where(right, base + width, base)
            merged = order.copy()
            merged[first[todo] + base + own + rank] = mine
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """The common extension of each suffix with the one before it in ``order``; 0 across groups."""
        out = np.zeros(len(order), np.int64)
        if len(order) > 1:
            out[1:] = np.where(self.group[order[1:]] == self.group[order[:-1]], self.common(order[1:], order[:-1]), 0)
        return out

    def verified(self, raw: bytes, order: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Whether each suffix really shares its ``ahead`` bytes with the one before it and comes after it, or
        is equal. Where that holds throughout a group, its order and common extensions are exact."""
        ok = np.ones(len(order), bool)
        if len(order) > 1:
            a, b, n = order[:-1], order[1:], ahead[1:]
            ok[1:] = same_bytes(raw, self.start[a], self.start[b], n) & ((self.group[a] != self.group[b]) | (self._next(a, n) <= self._next(b, n)))
        return ok


def same_bytes(raw: bytes, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from p on are those from q on."""
    return np.fromiter((raw[a : a + m] == raw[b : b + m] for a, b, m in zip(p.tolist(), q.tolist(), n.tolist(), strict=True)), bool, len(p))
