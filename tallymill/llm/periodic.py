"""Periodic runs of words: found by the linear tandem-repeat method (``tandem``) and collapsed to their first period.

A run is a stretch of words with smallest period q, at least LEAST words and TIMES periods long, that goes on to neither side. Where a run holds at
least TIMES periods and 24 words, some 16 words in it repeat q words on, so each run lies in a stretch covered by the 16-word strings that come again within
a third of the document. Only these stretches (none in most texts) are searched by the method, which finds all of their runs, in time and memory
proportional to n log n of a document's words. A document is searched whole, in one task.

Words are runs of bytes other than ASCII white space and are compared by 64-bit hashes.

Defined results: a null or empty text, or one without words, has no runs and an empty collapsed text; repeated rows are treated each; ties
do not arise, as all runs are returned; an empty table gives no rows; texts of any length are taken whole; other columns are ignored,
whatever their names; a null doc_id is kept (the query hashes it as the empty text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, ragged, raw, slices, table
from .spans import spans
from .tandem import runs

LEAST, TIMES = 24, 3
GRAM_LEVELS = 4  # strings of 16 words
RUN = "struct<start: bigint, length: bigint, period: bigint>"

_WORD = np.ones(256, bool)
_WORD[0x20] = _WORD[0x09:0x0E] = False
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, (64, 256), dtype=np.uint64) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    row, place = ragged(length)
    value = _BYTE[place & 63, data[start[row] + place]]
    if int(length.max()) > 64:
        value *= (2 * (place >> 6) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * _A)


def zones(word: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The zone of each word, counted from 1 and of one document each; 0 where no run can lie."""
    n, g = len(word), word
    width = 1 << GRAM_LEVELS
    for k in range(GRAM_LEVELS):
        w = 1 << k
        g = mix(g[: len(g) - w] * _A + g[w:] * _B) if len(g) > w else g[:0]
    at = np.flatnonzero(doc[: len(g)] == doc[width - 1 :][: len(g)])
    key = mix(g[at] + doc[at].astype(np.uint64) * _B)
    order = np.argsort(key)
    key, at = key[order], at[order]
    twin = np.zeros(len(key) + 1, bool)
    twin[1:-1] = key[1:] == key[:-1]
    some = twin[1:] | twin[:-1]
    key, at = key[some], at[some]
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    pair = np.flatnonzero((key[1:] == key[:-1]) & (TIMES * (at[1:] - at[:-1]) <= size[doc[at[1:]]])) if len(at) else np.zeros(0, np.int64)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[pair], 1)
    np.add.at(cover, at[pair + 1] + width, -1)
    inside = np.cumsum(cover[:-1]) > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    return np.cumsum(begin) * inside


def document_runs(word: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(start, end, period), counted over all words, of the runs of every document, by start, then period."""
    zone = zones(word, doc, size)
    at = np.flatnonzero(zone)
    found = runs(np.unique(mix(word[at] + zone[at].astype(np.uint64) * _B), return_inverse=True)[1])
    start, end, period = found.T
    ok = end - start >= np.maximum(LEAST, TIMES * period)
    return np.stack([at[start[ok]], at[end[ok] - 1] + 1, period[ok]], 1)


def collapse_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(runs: document, start in it, length, period; words of each document; texts of the words that stay, joined by one space)."""
    data, off = raw(texts)
    start, length, doc = spans(_WORD[data], off)
    n = len(off) - 1
    size = np.bincount(doc, minlength=n)
    found = document_runs(word_hashes(data, start, length), doc, size)
    drop = np.zeros(len(start) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 1], -1)
    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    # each word that stays with one space behind, but for the document's last
    start, length, of = start[stay], length[stay], doc[stay]
    gap = np.ones(len(stay), np.int64)
    gap[np.flatnonzero(np.diff(of, append=-1))] = 0
    row, place = ragged(length + gap)
    out = np.full(len(row), 0x20, np.uint8)
    real = place < length[row]
    out[real] = data[start[row[real]] + place[real]]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, weights=length + gap, minlength=n).astype(np.int64))])
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
    which = doc[found[:, 0]]
    first = (np.cumsum(size) - size)[which]
    return np.stack([which, found[:, 0] - first, found[:, 1] - found[:, 0], found[:, 2]], 1), size, text.cast(pa.string()) if ends[-1] < 1 << 31 else text


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, size, text = collapse_texts(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=batch.num_rows))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found[:, 1:].T], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(ends, items), text], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's input: in one document of ten, chosen by its id's crc32, the words from one on repeat with a period that the crc32 sets."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("long"))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]++"), F.lit(0))
    once = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_join(repeat(ws), " ")).otherwise(""))
    return F.when((h % 10 == 0) & text.isNotNull(), once[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    longer = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | longer(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = collapse(docs).withColumns({"best": best, "lines": lines})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
