"""Hashed word shingles of Arrow text columns.

Words are runs of letters, marks and digits, lower-cased. A text with one to four words has one shingle, all its
words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix
from .ngrams import BREAK, word_bytes

WIDTH = 5
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, (64, 256), dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(17).integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of every word, in order."""
    data, doc = word_bytes(texts)
    at = np.flatnonzero(data == BREAK)
    if len(at) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(at, append=len(data))
    place = np.arange(len(data)) - np.repeat(at, size)
    value = _BYTE[place & 63, data]
    if int(size.max()) > 64:
        value = value * (2 * (place >> 6) + 1).astype(np.uint64)
    real = np.flatnonzero((doc[at[:-1]] == doc[at[1:]]) & (size[:-1] > 1))
    return mix(np.add.reduceat(value, at)[real]), doc[at[real]]


def grams(w: np.ndarray, doc: np.ndarray, n: int, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of every run of ``width`` words of the ``n`` documents, in order; short: a text of fewer words gives one run, all its words."""
    size = np.bincount(doc, minlength=n)
    place = np.arange(len(w)) - (np.cumsum(size) - size)[doc]
    start = np.flatnonzero((place + width <= size[doc]) | (place == 0) & short)
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        there = place[start] + k < size[doc[start]]
        total += np.where(there, w[np.minimum(start + k, len(w) - 1)] * _STEP[k], np.uint64(0))
    return mix(total), doc[start]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of every shingle, in order, repeats included."""
    w, doc = words(texts)
    return grams(w, doc, len(texts), WIDTH, short=True) if len(w) else (w, doc)


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of every document's distinct shingles, sorted by document and hash."""
    h, doc = shingles(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(at, append=len(h))
