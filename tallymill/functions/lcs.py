"""Longest common subsequences of many pairs of short names at once.

Each pair is a lane of one 64-bit number: bit k says whether the table's row grows at letter k of the longer name. One numpy step moves all lanes
on by one letter of the shorter name (Hyyrö's bit-parallel row, here side by side), so a batch takes as many steps as its longest shorter name has
letters. Lanes are for ASCII names of at most 64 letters on the longer side, as normal names nearly always are; other pairs are
computed one by one with Python's long numbers.
"""

from __future__ import annotations

import numpy as np

LANE = 64


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence of one pair, of any length."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Names:
    """A list of different names as one array of letters, with the place of each letter in each name as bits."""

    def __init__(self, names: list[str]):
        self.names = names
        joined = "".join(names)
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.start = np.cumsum(self.size) - self.size
        self.plain = joined.isascii()
        self.data = np.frombuffer(joined.encode(), np.uint8) if self.plain else None

    def masks(self, which: np.ndarray) -> np.ndarray:
        """[len(which), 128]: the places of each letter in names of at most LANE letters."""
        out = np.zeros((len(which), 128), np.uint64)
        size, start = self.size[which], self.start[which]
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            out[at, self.data[start[at] + k]] |= np.uint64(1) << np.uint64(k)
        return out

    def lanes(self, long: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """LCS of each name ``long`` (at most LANE letters) and the ``length`` letters at ``begin`` of the array."""
        some, at = np.unique(long, return_inverse=True)
        masks = self.masks(some).ravel()
        order = np.argsort(-length, kind="stable")  # lanes with letters left come first
        at, begin, left = at[order] * 128, begin[order], -length[order]
        row = np.full(len(order), ~np.uint64(0))
        for k in range(int(-left.min(initial=0))):
            m = int(np.searchsorted(left, -k))
            r = row[:m]
            u = r & masks[at[:m] + self.data[begin[:m] + k]]
            row[:m] = (r + u) | (r ^ u)
        size = self.size[long[order]].astype(np.uint64)
        used = np.where(size == LANE, ~np.uint64(0), (np.uint64(1) << (size & np.uint64(LANE - 1))) - np.uint64(1))
        out = np.empty(len(order), np.int64)
        out[order] = np.bitwise_count(~row & used)
        return out

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """LCS of each pair of names, given by their numbers."""
        swap = self.size[a] < self.size[b]
        long, short = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), np.int64)
        fits = (self.size[long] <= LANE) & self.plain
        at = np.flatnonzero(fits)
        out[at] = self.lanes(long[at], self.start[short[at]], self.size[short[at]])
        for i in np.flatnonzero(~fits):
            out[i] = lcs_length(self.names[long[i]], self.names[short[i]])
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """2 LCS / (|a| + |b|); 1 for two empty names."""
        both = self.size[a] + self.size[b]
        return np.where(both == 0, 1.0, 2 * self.lcs(a, b) / np.maximum(1, both))

    def best_window(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The best similarity of the shorter name with a window of the longer one, of its length or shorter at the ends; 0 to 1."""
        out = np.zeros(len(a))
        empty = (self.size[a] == 0) | (self.size[b] == 0)
        out[empty] = (self.size[a] == self.size[b])[empty]
        swap = self.size[a] > self.size[b]
        short, long = np.where(swap, b, a), np.where(swap, a, b)
        at = np.flatnonzero(~empty)
        # of two names of one length, either is the shorter one
        same = at[self.size[short[at]] == self.size[long[at]]]
        pair = np.concatenate([at, same])
        short, long = np.concatenate([short[at], long[same]]), np.concatenate([long[at], short[same]])
        fits = (self.size[short] <= LANE) & self.plain
        for i in np.flatnonzero(~fits):
            out[pair[i]] = max(out[pair[i]], best_window(self.names[short[i]], self.names[long[i]]))
        pair, short, long = pair[fits], short[fits], long[fits]
        if not len(pair):
            return out
        # as many windows as there are places where they touch the longer name
        m, n = self.size[short], self.size[long]
        count = m + n - 1
        lane = np.repeat(np.arange(len(pair)), count)
        first = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count) + 1 - m[lane]
        begin, end = np.maximum(first, 0), np.minimum(first + m[lane], n[lane])
        found = 2 * self.lanes(short[lane], self.start[long[lane]] + begin, end - begin) / (m[lane] + end - begin)
        np.maximum.at(out, pair[lane], found)
        return out


def best_window(a: str, b: str) -> float:
    """As ``Names.best_window``, of one pair of any length."""
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    windows = {long[max(0, i) : i + m] for i in range(1 - m, n)}
    return max(2 * lcs_length(short, w) / (m + len(w)) for w in windows)
