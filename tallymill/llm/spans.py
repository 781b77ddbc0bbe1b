"""Stretches of bytes of one kind in the texts of a batch."""

from __future__ import annotations

import numpy as np


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of the stretches of true bytes, which end with their document; ``off``: where documents begin."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[True], inside])[:-1]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside, [True]])[1:])) + 1
    return start, end - start, np.searchsorted(off, start, "right") - 1
