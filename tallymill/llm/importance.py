"""Target-distribution importance resampling over hashed n-grams.

The features of a text are its runs of one to three words, each hashed to one of BUCKETS buckets. The document-by-bucket count matrix is
sparse and is written once, as CSR blocks: the rows of a bounded stretch of text with row sizes, column numbers and counts. Its
column sums give the distribution of the corpus, those of the benchmark's matrix the target distribution; a column's gain is the log ratio of
the two, and the sparse matrix-vector product with the gains gives each document's weight. Gumbel noise from a hash of the document's id turns
the weights into an exact draw without replacement: the highest scores are drawn.

The driver gets two vectors of BUCKETS numbers. Ranks are computed in stretches (``operators.ranks``), so no task holds all scores.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a null doc_id is hashed as the empty text and comes first
among ties; rows that repeat a doc_id are scored each, and ranked beside each other; rows equal in doc_id and score get ranks of their own; an empty table gives no rows;
an empty benchmark is the uniform distribution; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import with_rank
from .common import LARGE_GROUPS, LARGE_ROWS, materialize, raw, release, slices, small_batches, table, tidy
from .crc import word_run_crcs
from .spans import spans

BUCKETS, WORDS, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text in a block (a longer text is one of its own).
BLOCK_BYTES = 1 << 18

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, all lowest bytes first: small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def csr(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row size, column, count) of the count matrix of ``texts``: columns ascend in each row."""
    data, off = raw(texts)
    data = _LOWER[data]
    start, length, doc = spans(_IN_WORD[data], off)
    n = len(off) - 1
    found = word_run_crcs(data, start, length, doc, WORDS)
    key = np.concatenate([d * buckets + (c % np.uint32(buckets)).astype(np.int64) for c, d in found])
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(first, append=len(key))
    key = key[first]
    return np.bincount(doc, minlength=n), np.bincount(key // buckets, minlength=n), key % buckets, count


def blocks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """CSR blocks (ids, words, sizes, columns, counts) of the count matrix. Columns, at most 65,536, are stored as differences within their row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BLOCK_BYTES):
            words, size, column, count = csr(batch.column("text"), buckets)
            step = np.diff(column, prepend=0)
            begin = (np.cumsum(size) - size)[size > 0]
            step[begin] = column[begin]
            ids = batch.column("doc_id")
            one = np.array([0, len(ids)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, pa.array(words)), pa.ListArray.from_arrays(one, pa.array(size)), pa.array([planes(step.astype("<u2"))], pa.binary()), pa.array([planes(count.astype("<u4"))], pa.binary())],
                ["ids", "words", "sizes", "columns", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, words array<bigint>, sizes array<bigint>, columns binary, counts binary")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, row size, column, count) of each stored block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, words, size = (batch.column(c)[i].values for c in ("ids", "words", "sizes"))
            size = size.to_numpy()
            step = unplanes(batch.column("columns")[i].as_buffer(), "<u2").astype(np.int64)
            total = np.cumsum(step)
            begin = (np.cumsum(size) - size)[size > 0]
            column = total - np.repeat(np.concatenate([[0], total])[begin], size[size > 0])
            yield ids, words.to_numpy(), size, column, unplanes(batch.column("counts")[i].as_buffer(), "<u4")
        del batch
        release()


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sums of the matrix's columns: each task adds up its blocks, Spark the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, column, count in each_block(batches):
            total += np.bincount(column, weights=count, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    summed = matrix.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with small_batches(matrix.sparkSession, LARGE_ROWS):  # a stored block is one row of up to a megabyte
        rows = summed.collect()  # at most ``buckets`` rows
    sums = np.zeros(buckets, np.int64)
    for r in rows:
        sums[r["bucket"]] = r["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share of every bucket."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.asarray([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(source, target, strict=True)], np.int64)


def product(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stored blocks to (doc_id, n_words, n_features, weight): the sparse matrix times ``gain``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, size, column, count in each_block(batches):
            edge = np.concatenate([[0], np.cumsum(size)])
            weight = np.concatenate([[0], np.cumsum(gain[column] * count)])
            n = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(n[edge[1:]] - n[edge[:-1]]), pa.array(weight[edge[1:]] - weight[edge[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of a standard Gumbel number x from a hash of the id's decimal text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


@tidy("importance")
def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; drawn are ``percent`` of those with ``least_words`` words. target: column text."""
    matrix = materialize(blocks(docs), "csr", **LARGE_GROUPS)
    aim = blocks(target.select(F.lit(0).alias("doc_id"), "text"))
    gain = gains(column_sums(matrix), column_sums(aim))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = matrix.mapInArrow(product(gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    able = F.col("n_words") >= least_words
    scored = materialize(weighed.select("doc_id", able.alias("able"), "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scores", LARGE_ROWS)
    drawn = scored.filter("able").count() * percent // 100
    ranked = with_rank(scored, (), [F.desc("able"), F.desc("score"), F.col("doc_id")])
    rank = F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
