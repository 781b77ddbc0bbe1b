"""CRC-32 of many short byte strings at once, and of their joins.

The remainder is linear over GF(2): what a string leaves behind a given state is the state moved on by the string's length, xor what the
string leaves behind the state 0. So a run of words needs each word's bytes only once.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

FULL = np.uint32(0xFFFFFFFF)
NEAR = 64  # moves by fewer bytes have a table each


@functools.cache
def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, v >> 1 ^ np.uint32(0xEDB88320), v >> 1)
    return v


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear map, given as a table for each of the four bytes."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@functools.cache
def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Moves by 0 to 63 bytes, [64, 4, 256], and by 64 << k bytes, [26, 4, 256]."""
    one = _byte_table()
    near = np.empty((NEAR, 4, 256), np.uint32)
    near[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, NEAR):
        near[n] = one[near[n - 1] & 255] ^ near[n - 1] >> 8
    far = np.empty((26, 4, 256), np.uint32)
    far[0] = one[near[-1] & 255] ^ near[-1] >> 8
    for k in range(1, len(far)):
        far[k] = _apply(far[k - 1], far[k - 1])
    return near, far


def move(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The states after ``length`` zero bytes each."""
    near, far = _moves()
    n = length & NEAR - 1
    out = near[n, 0, state & 255] ^ near[n, 1, state >> 8 & 255] ^ near[n, 2, state >> 16 & 255] ^ near[n, 3, state >> 24]
    rest = length >> 6
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero(rest >> k & 1)
        out[at] = _apply(far[k], out[at])
    return out


def remainders(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each string ``data[start:start + length]`` leaves behind the state 0."""
    table = _byte_table()
    out = np.zeros(len(start), np.uint32)
    long = np.flatnonzero(length >= NEAR)
    for i in long:
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(np.where(length < NEAR, -length, 0), kind="stable")
    begin, size = start[order], np.where(length < NEAR, length, 0)[order]
    state = np.zeros(len(start), np.uint32)
    for p in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -p))  # strings longer than p come first
        state[:m] = table[(state[:m] ^ data[begin[:m] + p]) & 255] ^ state[:m] >> 8
    short = size > 0
    out[order[short]] = state[short]
    return out


def word_run_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(CRC-32, document) of all runs of 1, 2, ... ``most`` consecutive words of one document, joined by one space."""
    word = remainders(data, start, length)
    spaced = move(np.full(len(word), _byte_table()[0x20]), length) ^ word
    state, out = move(np.full(len(word), FULL), length) ^ word, []
    for k in range(most):
        if k:
            same = np.flatnonzero(doc[k:] == doc[:-k]) if len(doc) > k else np.zeros(0, np.int64)
            # runs of k words that end before word i go on with word i
            grown = np.zeros(len(word), np.uint32)
            grown[same] = move(state[same], length[same + k] + 1) ^ spaced[same + k]
            state = grown
        else:
            same = np.arange(len(word))
        out.append((state[same] ^ FULL, doc[same]))
    return out
