"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes chooses the cut points, so boundaries follow the content and an insertion
moves only the cuts near it. Chunks are compared by a 128-bit digest; of equal chunks the first one stays (smallest
doc_id, then position), the others are removed where they stand in a row of RUN bytes or more, or make up the whole
text: a few words that two sentences share by chance stay. The last chunk of a text takes part however short it is.

Defined results: null counts as the empty text (no chunk, nothing removed); rows that repeat a doc_id are the same
document and get the same result; a row without doc_id loses only what it repeats itself; a text of any length is chunked
whole; other columns are ignored (``filter_docs`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, raw, salted_join, slices, table, tidy

#: Chunk sizes in bytes: least (the width of the rolling hash), mean beyond the least, most.
LEAST, BITS, MOST = 32, 5, 256
#: Bytes of consecutive repeated chunks from which they are removed.
RUN = 96
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' gear values, each shifted by its age."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            older = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += older
    return h


def cut_points(marks: list[int], size: int) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes whose hash marks these places."""
    ends, last = [], 0
    for c in (*marks, size):
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST or c == size > last:
            ends.append(c)
            last = c
    return ends


def chunks(texts: pa.Array) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
    """(text, ends of its chunks, their digests) of every text."""
    data, off = raw(texts)
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    cut = np.searchsorted(marks, off, "right")
    whole = data.tobytes()
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), cut[:-1], cut[1:], strict=True):
        ends = cut_points((marks[i:j] - a).tolist(), b - a)
        digests, start = [], a
        for e in ends:
            digests.append(hashlib.blake2b(whole[start : a + e], digest_size=16).digest())
            start = a + e
        yield whole[a:b], ends, digests


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2): the distinct chunk digests of every document, as two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [set(digests) for _, _, digests in chunks(batch.column("text"))]
            halves = np.frombuffer(b"".join(b"".join(x) for x in each), np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "d1", "d2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, d1 long, d2 long")


@tidy("foreign-chunks")
def foreign(docs: DataFrame) -> DataFrame:
    """(doc_id, drop): the digests of chunks whose first copy lies in another document, as lists [d1, d2, d1, d2, ...]."""
    mine = materialize(chunk_table(docs), "chunks")
    bounds = mine.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialize(bounds.filter(F.col("first") != F.col("last")).select("d1", "d2", "first", "n"), "shared-chunks")
    often = materialize(hot_keys(shared, "d1", "d2"), "hot-chunks")
    hits = salted_join(mine, shared.select("d1", "d2", "first"), ["d1", "d2"], often, ["doc_id"]).filter(F.col("doc_id") != F.col("first"))
    return hits.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("d1", "d2"))).alias("drop"))


def removed(ends: list[int], digests: list[bytes], drop: set[bytes]) -> list[tuple[int, int]]:
    """Maximal removed spans of a text."""
    spans, seen, start = [], set(), 0
    for e, d in zip(ends, digests, strict=True):
        if d in seen or d in drop:
            spans[-1:] = [(spans[-1][0], e)] if spans and spans[-1][1] == start else [*spans[-1:], (start, e)]
        seen.add(d)
        start = e
    return [(a, b) for a, b in spans if b - a >= min(RUN, start)]


def digest_set(drop: list[int] | np.ndarray | None) -> set[bytes]:
    """The digests of a list [d1, d2, d1, d2, ...]."""
    whole = np.asarray(drop if drop is not None else [], np.int64).tobytes()
    return {whole[i : i + 16] for i in range(0, len(whole), 16)}


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def with_drops(docs: DataFrame) -> DataFrame:
    hits = foreign(docs)
    return docs.join(hits.withColumnRenamed("doc_id", "__hit_id").withColumnRenamed("drop", "__drop").hint("merge"), F.col("doc_id") == F.col("__hit_id"), "left").drop("__hit_id")


@tidy("chunk-dedup")
def chunk_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_chunks of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for (text, ends, digests), drop in zip(chunks(batch.column("text")), batch.column("__drop").to_pylist(), strict=True):
                spans = removed(ends, digests, digest_set(drop))
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut_out(text, spans)).hexdigest(), len(ends)))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = with_drops(docs.select("doc_id", "text"))
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chunks long")


def filter_docs(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` lacks the removed chunks (cut at whole characters: undecodable ends of a removed span stay out)."""

    @F.pandas_udf("string")
    def cleaned(texts, drops):
        import pandas as pd

        out = []
        for (text, ends, digests), drop, was in zip(chunks(pa.array(texts, pa.string(), from_pandas=True)), drops, texts, strict=True):
            spans = removed(ends, digests, digest_set(drop))
            out.append(cut_out(text, spans).decode("utf-8", "ignore") if spans else was)
        return pd.Series(out, dtype="object")

    return with_drops(docs).withColumn("text", cleaned("text", "__drop")).select(*docs.columns)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents"))
