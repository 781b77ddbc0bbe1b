"""Two-stage suffix sorting of many short strings at once, and their adjacent common prefixes.

Only suffixes smaller than their successors are sorted directly. All others follow by one scan over the buckets of
first bytes in ascending order: whatever stands before a suffix already in place, and is larger, goes to the next
free place of its own bucket. Strings are compared to their ends and DEPTH bytes deep at least, which is what repeats
of DEPTH bytes need.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import mix

_VALUE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
STRIDES = (64, 16)


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < 2**bits."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p, step = np.ones(1 << bits, np.uint64), base
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * np.uint64(step)
            step = step * step & (1 << 64) - 1
        out.append(p)
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of all prefixes, for window_hash."""
    power = _powers(max(20, int(len(data)).bit_length()))[0]
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=h[1:])
    return h


def window_hash(h: np.ndarray, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
    """64-bit hash of the bytes from a to b."""
    inverse = _powers(max(20, int(len(h) - 1).bit_length()))[1]
    return mix((h[b] - h[a]) * inverse[a])


class Suffixes:
    """Suffix array of the strings ``data[start[i]:start[i] + size[i]]``, which lie one behind the other."""

    def __init__(self, data: np.ndarray, size: np.ndarray, depth: int):
        self.depth, self.size = depth, size
        self.end = np.cumsum(size)
        self.start = self.end - size
        n = len(data)
        self.data = data
        self.last = np.repeat(self.end, size)  # end of each byte's string
        left = self.last - np.arange(n)
        wide = np.zeros(n + 8, np.uint64)
        wide[:n] = data
        eight = wide[:n] << np.uint64(56)
        for k in range(1, 8):
            eight |= np.where(left > k, wide[k : n + k], np.uint64(0)) << np.uint64(56 - 8 * k)
        self.eight, self.left = eight, left
        self.sums = sums = prefix_sums(data)
        at = np.arange(n)
        self.whole = window_hash(sums, at, np.minimum(at + depth, self.last))
        self.rising = self._rising()
        self.order = self._induce(self._sort_directly(np.flatnonzero(self.rising)))

    def _rising(self) -> np.ndarray:
        """Which suffixes are smaller than their successors (the empty one, at a string's end, is smallest)."""
        n = len(self.data)
        step = np.zeros(n, np.int64)
        step[:-1] = np.sign(self.data[1:].astype(np.int16) - self.data[:-1])
        step[self.end[self.size > 0] - 1] = -1
        known = np.flatnonzero(step)
        return step[known[np.searchsorted(known, np.arange(n))]] > 0 if n else np.zeros(0, bool)

    def _sort_directly(self, at: np.ndarray) -> np.ndarray:
        """Suffixes ``at`` in order: eight bytes at a time, until those that are still together agree DEPTH bytes deep.

        Groups that agree on the next STRIDES bytes (by hash) skip them.
        """
        at = at[np.argsort(self.eight[at], kind="stable")]
        key = self.eight[at]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        todo, deep = np.arange(len(at)), np.full(len(at), 8)
        while len(todo):
            # new: where groups begin; only those of several suffixes that differ within DEPTH bytes go on
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(todo))
            w = self.whole[at[todo]]
            mixed = (size > 1) & ~np.logical_and.reduceat(w == np.repeat(w[first], size), first)
            mixed &= deep[first] < self.depth
            keep = np.repeat(mixed, size)
            todo, deep, new, size = todo[keep], deep[keep], new[keep], size[mixed]
            for stride in STRIDES:
                if not len(todo):
                    break
                first = np.flatnonzero(new)
                p = at[todo] + deep
                ahead = window_hash(self.sums, np.minimum(p, self.last[at[todo]]), np.minimum(p + stride, self.last[at[todo]]))
                same = np.logical_and.reduceat((ahead == np.repeat(ahead[first], size)) & (self.last[at[todo]] - p >= stride), first)
                deep = deep + stride * np.repeat(same, size)
            if not len(todo):
                break
            p = at[todo]
            here = self.left[p] > deep
            key = np.where(here, self.eight[np.minimum(p + deep, len(self.eight) - 1)], np.uint64(0))
            group = np.cumsum(new)
            order = np.lexsort((key, group))
            key = key[order]
            at[todo] = p[order]
            deep = deep + 8
            new[1:] |= key[1:] != key[:-1]
        return at

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        """The whole order, from the directly sorted suffixes."""
        data, n = self.data, len(self.data)
        before = np.full(n, -1, np.int16)  # the byte in front of each suffix, in its string
        before[1:] = data[:-1]
        before[self.start[self.size > 0]] = -1
        bounds = np.searchsorted(data[direct], np.arange(257))
        falling: list[list[np.ndarray]] = [[] for _ in range(256)]

        def put(p: np.ndarray) -> None:
            if len(p):
                c = data[p]
                order = np.argsort(c, kind="stable")
                p, c = p[order], c[order]
                cut = np.flatnonzero(np.diff(c, prepend=-1).astype(np.int16))
                for a, b in zip(cut, [*cut[1:], len(p)], strict=True):
                    falling[c[a]].append(p[a:b])

        data16 = data.astype(np.int16)
        data = data16
        put(self.end[self.size > 0] - 1)  # the last byte of every string stands before the empty suffix
        out = []
        for c in range(256):
            done = 0
            while done < len(falling[c]):  # grows while runs of c are followed backwards
                wave = np.concatenate(falling[c][done:]) if len(falling[c]) - done > 1 else falling[c][done]
                falling[c][done:] = [wave]
                done += 1
                put(wave[before[wave] >= c] - 1)
            rising = direct[bounds[c] : bounds[c + 1]]
            put(rising[before[rising] > c] - 1)
            out += [*falling[c], rising]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repeated(self) -> np.ndarray:
        """For each byte: whether the DEPTH bytes from there (in its string) stand at another place too."""
        p, q = self.order[:-1], self.order[1:]
        full = self.left >= self.depth
        near = np.flatnonzero((self.whole[p] == self.whole[q]) & full[p] & full[q])
        p, q = p[near], q[near]
        for k in [*range(0, self.depth - 7, 8), self.depth - 8] if self.depth >= 8 else []:  # common prefix of neighbours
            ok = self.eight[p + k] == self.eight[q + k]
            if not ok.all():
                p, q = p[ok], q[ok]
        out = np.zeros(len(self.data), bool)
        out[p] = out[q] = True
        return out
