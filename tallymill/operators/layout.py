"""Reading-order text lines from positioned boxes and words.

Boxes are read record by record in order of their centres, and where a box goes depends on the lines so far. All records of a batch are read
in step: the k-th boxes of all of them are placed by one set of array operations, on each record's last RECENT lines with their tops and
bottoms in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_OVERLAP, MOST_SKEW, RECENT, WIDE, GAP = 0.5, np.radians(20), 4, 1.5, 3.0
#: Records times boxes that are read in step: records of like sizes go together, so that a long one does not widen the arrays of the others.
CELLS = 1 << 18


def group_medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of each group's values, NaN without any."""
    order = np.lexsort((values, group))
    values, size = values[order], np.bincount(group, minlength=n)
    start = np.cumsum(size) - size
    out, some = np.full(n, np.nan), size > 0
    out[some] = (values[(start + (size - 1) // 2)[some]] + values[(start + size // 2)[some]]) / 2
    return out


def skews(quads: np.ndarray, record: np.ndarray, n: int) -> np.ndarray:
    """Median angle of the top edges of each record's clearly wide boxes; 0 if there are none or the page would lie on its side."""
    top, side = quads[:, 1] - quads[:, 0], quads[:, 3] - quads[:, 0]
    width, height = np.hypot(*top.T), np.hypot(*side.T)
    wide = (width > WIDE * height) & (width > 0)
    angle = group_medians(np.arctan2(top[wide, 1], top[wide, 0]), record[wide], n)
    return np.where(np.abs(angle) < MOST_SKEW, angle, 0.0)


class Recent:
    """The last RECENT lines of each record, oldest first: tops and bottoms in sorted order, padded with infinity."""

    def __init__(self, n: int):
        self.edges = np.full((2, n, RECENT, 4), np.inf)
        self.count = np.zeros((n, RECENT), np.int64)
        self.line = np.full((n, RECENT), -1)

    def medians(self, rows: np.ndarray) -> np.ndarray:
        count = self.count[rows]
        low, high = np.maximum(count - 1, 0) // 2, np.where(count > 0, count // 2, 0)
        at = self.edges[:, rows]
        pick = lambda k: np.take_along_axis(at, np.broadcast_to(k[None, :, :, None], (2, *k.shape, 1)), 3)[..., 0]
        return (pick(low) + pick(high)) / 2

    def begin(self, rows: np.ndarray, line: np.ndarray) -> None:
        """A new line for these records; the oldest one is forgotten."""
        for x in (self.count, self.line):
            x[rows, :-1] = x[rows, 1:]
        self.edges[:, rows, :-1] = self.edges[:, rows, 1:]
        self.edges[:, rows, -1] = np.inf
        self.count[rows, -1], self.line[rows, -1] = 0, line

    def add(self, rows: np.ndarray, slot: np.ndarray, values: np.ndarray) -> None:
        """values: [2, rows] top and bottom of the box that joins each record's line in ``slot``."""
        if len(rows) and int(self.count[rows, slot].max()) >= self.edges.shape[3]:
            self.edges = np.concatenate([self.edges, np.full_like(self.edges, np.inf)], 3)
        held = self.edges[:, rows, slot]
        place = (held <= values[..., None]).sum(2)[..., None]
        k = np.arange(held.shape[2])
        moved = np.concatenate([held[..., :1], held[..., :-1]], 2)
        self.edges[:, rows, slot] = np.where(k < place, held, np.where(k == place, values[..., None], moved))
        self.count[rows, slot] += 1


def assign(top: np.ndarray, bottom: np.ndarray, sizes: np.ndarray, min_overlap: float) -> np.ndarray:
    """The line of each box, counted within its record. Records lie one after the other, by falling size, their boxes in reading order."""
    n, start = len(sizes), np.cumsum(sizes) - sizes
    recent, lines, out = Recent(n), np.zeros(n, np.int64), np.zeros(len(top), np.int64)
    for k in range(int(sizes.max(initial=0))):
        rows = np.arange(int(np.searchsorted(-sizes, -k)))  # records with a k-th box come first
        at = start[rows] + k
        t, b = top[at][:, None], bottom[at][:, None]
        y0, y1 = recent.medians(rows)
        with np.errstate(invalid="ignore"):
            part = (np.minimum(b, y1) - np.maximum(t, y0)) / np.maximum(1e-6, np.minimum(b - t, y1 - y0))
        part[(recent.count[rows] == 0) | ~(part >= min_overlap) | ~(part > 0)] = -1
        slot = part.argmax(1)  # of equal ones the oldest
        new = part[rows, slot] < 0
        recent.begin(rows[new], lines[rows[new]])
        slot[new] = RECENT - 1
        lines[rows[new]] += 1
        recent.add(rows, slot, np.stack([t[:, 0], b[:, 0]]))
        out[at] = recent.line[rows, slot]
    return out


def read_lines(quads: np.ndarray, texts: list[str], sizes: np.ndarray, min_overlap: float = MIN_OVERLAP) -> list[list[str]]:
    """Lines of each record, whose ``sizes`` boxes follow each other, given by four corners each. A box joins the one of the last four lines
    that it overlaps most."""
    n, record = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    angle = skews(quads, record, n)[record][:, None]
    x, y = quads[:, :, 0], quads[:, :, 1]
    across, down = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
    left, right, top, bottom = across.min(1), across.max(1), down.min(1), down.max(1)
    order = np.lexsort(((top + bottom) / 2, record))
    start = np.cumsum(sizes) - sizes
    line = np.zeros(len(record), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    while len(by_size) and sizes[by_size[0]]:
        some = by_size[: max(1, CELLS // int(sizes[by_size[0]]))]
        by_size = by_size[len(some) :]
        inside = np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        at = order[np.repeat(start[some], sizes[some]) + np.arange(len(inside)) - inside]
        line[at] = assign(top[at], bottom[at], sizes[some], min_overlap)
    order = order[np.lexsort((left[order], line[order], record[order]))]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(record[order]) != 0) | (np.diff(line[order]) != 0)
    of = np.cumsum(new) - 1
    letters = np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))
    char = group_medians(((right - left) / letters)[order], of, int(of[-1]) + 1 if len(of) else 0)
    wide = np.zeros(len(order), bool)
    wide[1:] = left[order[1:]] - right[order[:-1]] > GAP * char[of[1:]]
    out: list[list[str]] = [[] for _ in range(n)]
    first = np.flatnonzero(new).tolist()
    order_, wide_, record_ = order.tolist(), wide.tolist(), record.tolist()
    for a, b in zip(first, [*first[1:], len(order_)], strict=True):
        text = texts[order_[a]]
        for k in range(a + 1, b):
            text += ("   " if wide_[k] else " ") + texts[order_[k]]
        if text := text.strip():
            out[record_[order_[a]]].append(text)
    return out


def reconstruct_lines(ocr: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(id, lines) from (id, boxes), in Arrow batches. A record without boxes has no lines; a box without text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = batch.column("boxes")
            sizes = pc.list_value_length(boxes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, lines = boxes.flatten(), [[] for _ in sizes]
            if len(flat):  # children of empty lists have no offsets to read
                quads = flat.field("quad").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 2)
                lines = read_lines(quads, [t or "" for t in flat.field("text").to_pylist()], sizes, min_overlap)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines, pa.list_(pa.string()))], ["id", "lines"])

    kind = ocr.schema["id"].dataType.simpleString()
    return ocr.select("id", "boxes").mapInArrow(run, f"id {kind}, lines array<string>")


def word_lines(words: DataFrame) -> DataFrame:
    """(id, lines) from words (id, group_id, row_id, has_row_id, x1, x3, y1, y3, text): words of a row by (x, y, text), rows by mean y, then text.

    The row falls back to the group only where the row id is missing, not where it is null.
    """
    x, y = (F.col("x1") + F.col("x3")) / 2, (F.col("y1") + F.col("y3")) / 2
    row = F.when(F.col("has_row_id"), F.col("row_id")).otherwise(F.col("group_id"))
    placed = words.select("id", row.alias("row"), F.struct(x.alias("x"), y.alias("y"), F.col("text").alias("text")).alias("w"))
    lines = placed.groupBy("id", "row").agg(F.avg("w.y").alias("y"), F.sort_array(F.collect_list("w")).alias("ws"))
    lines = lines.select("id", F.struct("y", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text")).alias("line"))
    return lines.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("line")), lambda v: v["text"]).alias("lines"))
