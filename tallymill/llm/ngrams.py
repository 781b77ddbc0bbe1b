"""Hashed byte n-grams of Arrow text columns, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import raw

BREAK = 0x20


def plain_text(texts: pa.Array) -> pa.Array:
    """Lower-cased texts whose runs of characters other than letters and digits are one space."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return pc.replace_substring_regex(lowered, r"[^\p{L}\p{M}\p{N}]+", " ")


def word_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document of each byte): every document's words with one space before, between and after them."""
    space = pa.scalar(" ", pa.large_string())
    data, off = raw(pc.replace_substring_regex(pc.binary_join_element_wise(space, plain_text(texts), space, pa.scalar("", pa.large_string())), r" +", " "))
    return data, np.repeat(np.arange(len(texts)), np.diff(off))


def ngram_buckets(data: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each n-gram of bytes that lies in one document and has a space at its ends only."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = doc[:m] == doc[n - 1 :]
    space = data == BREAK
    for k in range(1, n - 1):
        ok &= ~space[k : k + m]
    if n == 1:
        ok &= ~space
    if n == 2:
        ok &= ~(space[:-1] & space[1:])
    at = np.flatnonzero(ok)
    v = np.full(len(at), n, np.uint64)
    for k in range(n):
        v = v << np.uint64(8) | data[at + k]
    v = (v ^ (v >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
    return (v >> np.uint64(64 - bits)).astype(np.int64), doc[at]


_PLACE = np.random.default_rng(11).integers(1, 1 << 63, (32, 256), dtype=np.uint64) | np.uint64(1)


def word_buckets(data: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each whole word."""
    at = np.flatnonzero(data == BREAK)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(data)) - at[np.maximum(np.searchsorted(at, np.arange(len(data)), "right") - 1, 0)]
    sums = np.add.reduceat(_PLACE[place & 31, data], at)[:-1]
    real = (doc[at[:-1]] == doc[at[1:]]) & (np.diff(at) > 1)
    v = sums[real]
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (v >> np.uint64(64 - bits)).astype(np.int64), doc[at[:-1][real]]
