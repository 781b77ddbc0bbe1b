"""Shared helpers: durable intermediate tables and raw UTF-8 buffers of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import drop, keep, scope

#: Bytes of text handled at once by the array operators; bounds their temporaries.
SLICE_BYTES = 1 << 20
#: A key is hot if it has at least HOT_LEAST rows and 1/HOT_SHARE of all rows. At most HOT_SHARE keys can be hot, which bounds their broadcast.
HOT_SHARE, HOT_LEAST, SALTS = 1024, 1000, 32
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: For tables whose rows have up to a megabyte: the reader decodes so many rows at once, whatever their size, and a row group is held compressed.
LARGE_ROWS, LARGE_GROUPS = {"spark.sql.parquet.columnarReaderBatchSize": "8"}, {"parquet.block.size": str(16 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Arrow batches of bounded size while a job runs: the JVM and the Python workers each hold a batch outside the heap. more: further settings."""
    wanted = BATCHES | (more or {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, more: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. ``tidy`` deletes it."""
    with small_batches(df.sparkSession, more):
        return keep(df, label, **options)


def tidy(label: str) -> Callable:
    """Decorator: the function's DataFrame is written out, then the intermediate tables it made are deleted; the result goes when the process ends."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **named) -> DataFrame:
            made: list[str] = []
            try:
                with scope() as made:
                    df = f(*args, **named)
                return materialize(df, label)
            finally:
                drop(SparkSession.active(), made)

        return run

    return wrap


def hot_keys(sizes: DataFrame, *keys: str) -> DataFrame:
    """The hot keys of (keys, n), n being their numbers of rows."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sizes.filter(F.col("n") >= max(HOT_LEAST, -(-total // HOT_SHARE))).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the much smaller ``right`` on ``keys``: the left rows of a hot key are dealt out by a hash of ``spread``, its right rows
    copied to each deal. The result is that of a plain join."""
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    deal = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, keys, "left").withColumn("__deal", deal).drop("__hot")
    b = right.join(hot, keys, "left").withColumn("__deal", F.explode(every)).drop("__hot")
    return a.join(b.hint("merge"), [*keys, "__deal"], how).drop("__deal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; 0 marks held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def hash_below(key: Column, rate: Column | float) -> Column:
    """True for about ``rate`` of the keys, chosen by a fixed hash."""
    return (F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 30)) / float(1 << 30)) < rate


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_binary(arr.type) else arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if offs is not None and len(offs) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: an idle Python worker keeps its share of the executor's memory otherwise."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches so that ``column`` holds about ``limit`` bytes at most (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)
        del batch
        release()


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, position in its row) of rows of the given lengths."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), on uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
