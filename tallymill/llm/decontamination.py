"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items fall into size classes by their number of distinct shingles, as powers of two. The sketch of an item is its
shingle hashes under the limit of its class: all of them up to KEEP shingles, about KEEP/2 to KEEP of larger items. A
document of any length is sketched by the same limits, so the two agree on every shared shingle under the limit, and a
short item shows in a long document as well as in a short one. A document can contain an item only if it holds some of
the sketch; how many of it may be missing says how many of the sketch's hashes need to be looked up, and the ones that
fewest items share are taken. Whole sketches make this exact; of sampled ones LEAST must be shared, and an item of which
0.8 is contained shares less with probability under 1e-6. Candidates are verified by counting shared shingles in full.

Everything is joins of tables by shingle hash. What is broadcast is one bit map of all items' shingles, of at most
2**MOST_BITS bits however many items there are; a document's shingles that it does not hold are dropped where they arise.

Defined results: an item of one to four words has one shingle, all its words, and is found wherever they stand in a row;
documents or items without words (null, empty) match nothing; rows with the same item_id and different texts are different
items under one id, equal rows are one item; rows that repeat a document with its text are one document, those with another
text are matched by their own; texts of any length are searched whole; ids may be of any type and null; other columns are
ignored (``filter_docs`` keeps them); empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_join, slices, table, tidy
from .shingles import WIDTH, grams, shingles, weighted, words

CONTAINED, KEEP, LEAST = 0.8, 32, 0.25
#: Bits of the map for each item shingle, and log2 of the least and most bits; beyond the most (32 MB) more shingles pass and the joins drop them.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 20, 28
MAP_BITS = 32768  # of one value of bitmap_construct_agg
KEY = ["k1", "k2"]


def limit(size: np.ndarray) -> np.ndarray:
    """The largest hash in the sketch of a text with ``size`` distinct shingles."""
    share = np.minimum(1.0, KEEP / np.exp2(np.ceil(np.log2(np.maximum(size, 1)))))
    return np.where(share < 1, share * 2.0**64, 0).astype(np.uint64) - np.uint64(1)  # 0 - 1: all


def needed(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many hashes of its sketch a contained item shares."""
    return np.where(sketch == size, np.ceil(CONTAINED * sketch - 1e-9), np.ceil(LEAST * sketch)).astype(np.int64)


def postings(items: DataFrame) -> DataFrame:
    """(item, item_id, h, size, width, part): every distinct shingle of every item; part: how many of the sketch are to be looked up, null outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n = batch.column("text"), batch.num_rows
            row, h, _ = weighted(texts)
            size = np.bincount(row, minlength=n)
            width = np.clip(np.bincount(words(texts)[1], minlength=n), 1, WIDTH)
            inside = h <= limit(size)[row]
            inside |= (np.bincount(row[inside], minlength=n) == 0)[row]
            sketch = np.bincount(row[inside], minlength=n)
            part = pa.array((sketch - needed(sketch, size) + 1)[row], mask=~inside)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), pa.array(h.view(np.int64)), pa.array(size[row]), pa.array(width[row]), part], ["item", "item_id", "h", "size", "width", "part"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item long, item_id {kind}, h long, size long, width long, part long")


def bit_map(all_items: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes, log2 of the bits): the bits of the leading digits of every item shingle."""
    n = all_items.count()
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(1, n * BITS_EACH)))), MOST_BITS)
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = all_items.groupBy(F.floor(place / MAP_BITS).alias("at")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(MAP_BITS))).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["at"] * MAP_BITS // 8 :][: MAP_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a 128-bit key of doc_id and text."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})


def hits(docs: DataFrame, known: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """(doc_id, k1, k2, h): the distinct shingles of each document whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w, doc = words(batch.column("text"))
            each = [grams(w, doc, batch.num_rows, width) for width in widths] if len(w) else []
            h, row = (np.concatenate(x) for x in zip(*each, strict=True)) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            place = h >> np.uint64(64 - bits)
            there = known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
            h, row = h[there], row[there]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", *KEY)), pa.array(h[new].view(np.int64))], ["doc_id", *KEY, "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, h long").distinct()


@tidy("contained")
def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, k1, k2, item_id, n_shared, n_item, containment of every document and item that it contains."""
    distinct = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    listed = materialize(postings(materialize(distinct.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")), "postings")
    widths = sorted(r["width"] for r in listed.select("width").distinct().collect())
    mine = materialize(hits(docs, *bit_map(listed), widths), "hits")
    # the sketch hashes that fewest items hold
    share = listed.groupBy("h").agg(F.count(F.lit(1)).alias("n_items"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("n_items", "h"))
    asked = listed.filter(F.col("part").isNotNull()).join(share.hint("merge"), "h").withColumn("place", place).filter(F.col("place") <= F.col("part"))
    often = materialize(hot_keys(mine.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"), "hot-hashes")
    pairs = salted_join(mine, asked.select("h", "item"), ["h"], often, KEY).select("doc_id", *KEY, "item").distinct()
    pairs = materialize(pairs, "candidates")
    common = materialize(hot_keys(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item"), "hot-items")
    wanted = salted_join(pairs, listed.select("item", "item_id", "h", "size"), ["item"], common, KEY)
    both = wanted.join(mine.select(*KEY, "h").hint("merge"), [*KEY, "h"])
    counted = both.groupBy("doc_id", *KEY, "item", "item_id", "size").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = counted.filter(F.col("n_shared") >= F.col("size") * CONTAINED - 1e-9)
    return enough.select("doc_id", *KEY, "item_id", "n_shared", F.col("size").alias("n_item"), (F.col("n_shared") / F.col("size")).alias("containment"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that holds an item."""
    return found(docs, items).drop(*KEY)


def filter_docs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    held = found(docs, items).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "text", "doc_id")
    return docs.join(held, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
