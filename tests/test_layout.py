"""Line building in step against a loop over boxes."""

import random
from statistics import median

import numpy as np
import pytest

from tallymill.operators import layout


def by_loop(quads, texts, min_overlap):
    """One record, box after box."""
    if not texts:
        return []
    edge, side = quads[:, 1] - quads[:, 0], quads[:, 3] - quads[:, 0]
    angles = [np.arctan2(e[1], e[0]) for e, s in zip(edge, side, strict=True) if np.hypot(*e) > 1.5 * np.hypot(*s)]
    angle = float(np.median(angles)) if angles else 0.0
    angle = angle if abs(angle) < np.radians(20) else 0.0
    x, y = quads[:, :, 0] * np.cos(angle) + quads[:, :, 1] * np.sin(angle), quads[:, :, 1] * np.cos(angle) - quads[:, :, 0] * np.sin(angle)
    left, right, top, bottom = x.min(1), x.max(1), y.min(1), y.max(1)
    lines = []
    for k in sorted(range(len(texts)), key=lambda k: (top[k] + bottom[k]) / 2):
        best, share = None, 0.0
        for line in lines[-4:]:
            y0, y1 = median(top[i] for i in line), median(bottom[i] for i in line)
            part = (min(bottom[k], y1) - max(top[k], y0)) / max(1e-6, min(bottom[k] - top[k], y1 - y0))
            if part >= min_overlap and part > share:
                best, share = line, part
        if best is None:
            lines.append([k])
        else:
            best.append(k)
    out = []
    for line in lines:
        line = sorted(line, key=lambda k: left[k])
        char = median((right[k] - left[k]) / max(1, len(texts[k])) for k in line)
        text = texts[line[0]]
        for a, b in zip(line, line[1:], strict=False):
            text += ("   " if left[b] - right[a] > 3 * char else " ") + texts[b]
        out.append(text.strip())
    return [t for t in out if t]


@pytest.mark.parametrize("min_overlap", [0.5, 0.0, 0.9])
def test_in_step_equals_the_loop(monkeypatch, min_overlap):
    monkeypatch.setattr(layout, "CELLS", 500)
    r = random.Random(11)
    records = []
    for i in range(160):
        # whole numbers make ties in centres, lefts and overlaps
        turn, n = np.radians(r.choice([0, 0, 3, -8, 19, 25, 90])), r.choice([0, 1, 2, 5, 17, 60])
        quads, texts = [], []
        for _ in range(n):
            x, y, w, h = r.randrange(0, 300, 10), r.randrange(0, 15 * (1 + n // 3), 3), r.choice([0, 5, 30, 80]), r.choice([0, 6, 9, 24])
            corners = ((x, y), (x + w, y), (x + w, y + h), (x, y + h))
            quads.append([(a * np.cos(turn) - b * np.sin(turn), a * np.sin(turn) + b * np.cos(turn)) for a, b in corners])
            texts.append(r.choice(["", " ", "a", "total", "12,000", "é" * 9]))
        records.append((np.asarray(quads, float).reshape(-1, 4, 2), texts))
    got = layout.read_lines(np.concatenate([q for q, _ in records]), [t for _, ts in records for t in ts], np.asarray([len(t) for _, t in records]), min_overlap)
    assert got == [by_loop(q, t, min_overlap) for q, t in records]


def test_one_very_long_record_beside_short_ones():
    quads = np.asarray([[(k * 10, 0), (k * 10 + 8, 0), (k * 10 + 8, 9), (k * 10, 9)] for k in range(5000)], float)
    got = layout.read_lines(np.concatenate([quads, quads[:2]]), [f"{k}" for k in range(5002)], np.asarray([5000, 0, 2]))
    assert [len(x) for x in got] == [1, 0, 1] and got[2] == ["5000 5001"] and got[0][0].split() == [str(k) for k in range(5000)]
