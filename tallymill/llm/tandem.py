"""All runs (maximal periodic stretches) of many sequences at once, by the linear tandem-repeat method.

1. Names: substrings of 2**k symbols get whole numbers that are equal for equal substrings and ordered like them (prefix doubling). The last
   level is the suffix array; two names tell how far two positions agree, in either direction.
2. Lempel-Ziv blocks, and from each block's border the squares whose first occurrence crosses it: a set that covers the leftmost occurrence
   of every square.
3. Suffix-link walks. The suffix array with its common prefixes stands for the suffix tree. From a square xbxb one goes to bxb, the suffix link, and
   on down by x: if the tree has that child, bxbx is a square too. Steps inside one stretch of equal period always succeed and are
   taken at once; the walk goes on from its end. The squares met are the whole vocabulary.
4. Every occurrence of a vocabulary square is a leaf below its node. Occurrences of one period that follow each other merge into a run.

Only squares of primitive roots are followed: their rotations are primitive too, a run's smallest period is that of its primitive
squares, and there are O(n log n) occurrences of them at most.
"""

from __future__ import annotations

import numpy as np

from .common import ragged


class Index:
    """Names, suffix array and common prefixes of one array of whole numbers from 0. Symbols of different sequences must differ."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        name = np.unique(x, return_inverse=True)[1].astype(np.int32)
        self.names, width = [name], 1
        while width < n and int(name.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            after[:-width] = name[width:] + 1
            key = name * np.int64(n + 1) + after
            # names that only one position has stay alone: others are renamed within their old class
            order = np.argsort(key, kind="stable")
            new = np.empty(n, bool)
            new[0] = True
            new[1:] = key[order[1:]] != key[order[:-1]]
            name = np.empty(n, np.int32)
            name[order] = np.cumsum(new) - 1
            self.names.append(name)
            width *= 2
        self.rank = name.astype(np.int64)
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)  # with the suffix before
        self.lcp[1:] = self.forward(self.sa[1:], self.sa[:-1])
        self.least = [self.lcp]
        while (w := 1 << len(self.least)) <= n:
            half = self.least[-1]
            self.least.append(np.minimum(half[: n - w + 1], half[w // 2 : n - w // 2 + 1]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree; i and j differ."""
        i, j = i.copy(), j.copy()
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            ok = (i < self.n) & (j < self.n)
            ok[ok] = name[i[ok]] == name[j[ok]]
            step = ok.astype(np.int64) << k
            i += step
            j += step
            done += step
        return done

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols that end before i and before j agree; i and j differ."""
        i, j = i.copy(), j.copy()
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, w = self.names[k], 1 << k
            ok = (i >= w) & (j >= w)
            ok[ok] = name[i[ok] - w] == name[j[ok] - w]
            step = ok.astype(np.int64) << k
            i -= step
            j -= step
            done += step
        return done

    def interval(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin like the ``length`` symbols from ``at`` on: the tree's node."""
        low = self.rank[at].copy()
        high = low.copy()
        for k in range(len(self.least) - 1, -1, -1):
            w, least = 1 << k, self.least[k]
            ok = low >= w
            ok[ok] = least[low[ok] - w + 1] >= length[ok]
            low -= ok * w
        for k in range(len(self.least) - 1, -1, -1):
            w, least = 1 << k, self.least[k]
            ok = high + w < self.n
            ok[ok] = least[high[ok] + 1] >= length[ok]
            high += ok * w
        return low, high

    def prior(self) -> np.ndarray:
        """For each position, the most symbols that an earlier position begins alike."""
        n, sa = self.n, self.sa.tolist()
        left, right, stack = [-1] * n, [-1] * n, []
        for p in sa:
            while stack and stack[-1] > p:
                right[stack.pop()] = p
            if stack:
                left[p] = stack[-1]
            stack.append(p)
        best = np.zeros(n, np.int64)
        for other in (np.asarray(left), np.asarray(right)):
            at = np.flatnonzero(other >= 0)
            best[at] = np.maximum(best[at], self.forward(at, other[at]))
        return best

    def blocks(self) -> np.ndarray:
        """Begins of the Lempel-Ziv blocks, and the end."""
        prior, out, at = self.prior().tolist(), [], 0
        while at < self.n:
            out.append(at)
            at += max(1, prior[at])
        return np.asarray([*out, self.n])

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of squares that cover the leftmost occurrence of every square."""
        x, edge = self.names[0], self.blocks()
        begin, end = edge[:-1], edge[1:]
        after = np.append(end[1:], self.n)  # end of the next block
        out = []
        # squares around the block's end, their second half there: the equal symbol lies in the block
        b, k = ragged(end - begin)
        k, h = k + 1, end[b]
        b, k, h = (v[ok] for ok in [h < self.n] for v in (b, k, h))
        same = x[h] == x[h - k]
        k, h = k[same], h[same]
        ahead, behind = self.forward(h, h - k), self.backward(h, h - k)
        ok = ahead + behind >= k
        out.append((np.maximum(h - k - behind, h - 2 * k + 1)[ok], k[ok]))
        # squares around the block's begin, their first half there
        b, k = ragged(after - begin)
        k, h = k + 1, begin[b]
        ok = (h + k < self.n) & (h > 0)
        k, h = k[ok], h[ok]
        same = x[h - 1] == x[h + k - 1]
        k, h = k[same], h[same]
        ahead, behind = self.forward(h, h + k), self.backward(h, h + k)
        ok = ahead + behind >= k
        out.append((np.maximum(h - behind, h - k + (ahead > 0))[ok], k[ok]))
        # and those that begin with the block
        b, k = ragged(after - begin)
        k, h = k + 1, begin[b]
        ok = h + k < self.n
        k, h = k[ok], h[ok]
        same = x[h] == x[h + k]
        k, h = k[same], h[same]
        ok = self.forward(h, h + k) >= k
        out.append((h[ok], k[ok]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def primitive(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the square's half is no power of a shorter word."""
        out = np.ones(len(start), bool)
        rest = period.copy()
        divisor = 2
        while len(live := np.flatnonzero(rest > 1)):
            if divisor * divisor > int(rest.max()):
                self._refuse(out, start, period, rest, live)
                break
            hit = live[rest[live] % divisor == 0]
            if len(hit):
                self._refuse(out, start, period, np.full(len(period), divisor), hit)
                while len(hit):
                    rest[hit] //= divisor
                    hit = hit[rest[hit] % divisor == 0]
            divisor += 1
        return out

    def _refuse(self, out: np.ndarray, start: np.ndarray, period: np.ndarray, prime: np.ndarray, at: np.ndarray) -> None:
        short = period[at] // prime[at]
        out[at] &= self.forward(start[at], start[at] + short) < 2 * period[at] - short

    def whole(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """(first square's start, last square's start, period) of the stretches around squares, each once."""
        if not len(start):
            return np.zeros((0, 3), np.int64)
        first = start - self.backward(start, start + period)
        last = start + self.forward(start, start + period) - period
        return np.unique(np.stack([first, last, period], 1), axis=0)


def squares(index: Index) -> np.ndarray:
    """(first, last, period) of stretches of primitive squares that hold the whole vocabulary."""
    start, period = index.covering()
    ok = index.primitive(start, period)
    known = front = index.whole(start[ok], period[ok])
    while len(front):
        # behind the last square xbxb of a stretch: the suffix link bxb, then down by x
        p, q = front[:, 1], front[:, 2]
        ok = p + 2 * q <= index.n - 1
        p, q = p[ok], q[ok]
        low, high = index.interval(p + 1, 2 * q - 1)
        ok = high > low
        p, q, low, high = p[ok], q[ok], low[ok], high[ok]
        symbol, x = index.names[0], index.names[0][p]
        a, b = low.copy(), high + 1
        while len(live := np.flatnonzero(a < b)):
            mid = (a[live] + b[live]) // 2
            at = index.sa[mid] + 2 * q[live] - 1
            below = np.where(at < index.n, symbol[np.minimum(at, index.n - 1)], -1) < x[live]
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
        there = a <= high
        at = np.where(there, index.sa[np.minimum(a, index.n - 1)], 0)
        there &= (at + 2 * q - 1 < index.n) & (symbol[np.minimum(at + 2 * q - 1, index.n - 1)] == x)
        found = index.whole(at[there], q[there])
        every, first = np.unique(np.concatenate([known, found]), axis=0, return_index=True)
        front = every[first >= len(known)]
        known = every
    return known


def runs(x: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of at least two periods, by start, then period."""
    if len(x) < 2:
        return np.zeros((0, 3), np.int64)
    index = Index(x)
    known = squares(index)
    if not len(known):
        return np.zeros((0, 3), np.int64)
    row, place = ragged(known[:, 1] - known[:, 0] + 1)
    start, period = known[row, 0] + place, known[row, 2]
    low, high = index.interval(start, 2 * period)
    node = np.unique(np.stack([low, high, period], 1), axis=0)  # the vocabulary
    row, place = ragged(node[:, 1] - node[:, 0] + 1)
    key = np.unique(node[row, 2] * np.int64(index.n) + index.sa[node[row, 0] + place])
    start, period = key % index.n, key // index.n
    new = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(period, prepend=0) != 0))
    last = np.append(new[1:], len(start)) - 1
    found = np.stack([start[new], start[last] + 2 * period[new], period[new]], 1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]
