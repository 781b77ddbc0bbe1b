"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a folder: a table of (digest, keep_id) bucketed and sorted by SHA-256 digest, and its number of buckets. Any
session that names the folder continues it. New data is reduced to one row for each digest, anti-joined to the index by
sort-merge, and what is new is appended; earlier entries never change. An append that was broken off can be repeated: what
it left is found by the anti-join.

``parts`` cuts the new data into batches by ranges of doc_id, the largest ids first, which are indexed one after another.
As the first batch that brings a text decides, and within it the largest doc_id, the result is that of one batch.

Defined results: a null text counts as the empty text; equal texts share one group, group_size is its rows in this call;
of its rows the largest doc_id stays, unless an earlier call has indexed the text: then the row of that call stays (none of
this call, except the same doc_id given again); rows that repeat a doc_id with its text are the same document and stay or go
together, those with another text are judged by their own; a group of rows without doc_id keeps them (null-safe comparison);
an empty table gives no rows; very long texts are digested whole; columns other than doc_id and text are ignored, and
``filter_docs`` returns all columns of its input unchanged.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove, shared_dir
from .common import materialize, table, tidy

#: A digest with at least 1/HOT_SHARE of all rows is hot. There can be at most HOT_SHARE such digests, which bounds the broadcast.
HOT_SHARE = 1024
#: Digests that a bucket of a new index is planned for, and the least and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 16, 8192


class DigestIndex:
    """The digest index in the folder ``path``; without a path, a temporary one that ``drop`` deletes."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}").rstrip("/")
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"

    def exists(self) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/plan/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def open(self, rows: int = 0, id_type: str = "bigint") -> DigestIndex:
        """Register the table over the folder's files in this session; a new index is planned for ``rows`` digests."""
        if not self.exists():
            buckets = min(max(LEAST_BUCKETS, rows // BUCKET_ROWS), MOST_BUCKETS)
            plan = self.spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            plan.write.mode("overwrite").parquet(f"{self.path}/plan")
        plan = self.spark.read.parquet(f"{self.path}/plan").first()
        self.buckets, place = plan["buckets"], f"{self.path}/data".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {plan['id_type']}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Add the groups of ``digests`` (doc_id, digest) that the index lacks: one sort-merge anti-join, one file for each bucket."""
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def annotate(self, digests: DataFrame, rows: int) -> DataFrame:
        """(doc_id, digest, keep_id, group_size) of every row; hot digests by a bounded broadcast, the rest by sort-merge join."""
        sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = materialize(sizes.hint("merge").join(self.read(), "digest"), "groups")
        least = max(2, -(-rows // HOT_SHARE))
        hot = groups.filter(F.col("group_size") >= least).withColumn("hot", F.lit(True))
        tagged = digests.join(F.broadcast(hot), "digest", "left")
        cold = tagged.filter(F.col("hot").isNull()).select("digest", "doc_id")
        rest = cold.join(groups.filter(F.col("group_size") < least).hint("merge"), "digest")
        cols = ["doc_id", "digest", "keep_id", "group_size"]
        return tagged.filter("hot").select(*cols).unionByName(rest.select(*cols))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def text_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_digest().alias("digest"))


def batches(rows: DataFrame, parts: int) -> list[DataFrame]:
    """``rows`` by ranges of doc_id, the largest first; rows without doc_id come last."""
    if parts < 2:
        return [rows]
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts - 1, 0, -1)])).first()[0] or []
    above = [F.coalesce(F.col("doc_id") > c, F.lit(False)) for c in dict.fromkeys(cuts)]
    bounds = zip([F.lit(False), *above], [*above, F.lit(True)], strict=True)
    return [rows.filter(~higher & mine) for higher, mine in bounds]


@tidy("exact-dedup")
def annotated(docs: DataFrame, index: DigestIndex, parts: int) -> DataFrame:
    mine = materialize(digests(docs), "digests")
    rows = mine.count()
    index.open(rows, docs.schema["doc_id"].dataType.simpleString())
    for batch in batches(mine, parts):
        index.append(batch)
    return index.annotate(mine, rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, parts: int = 1) -> DataFrame:
    """Index ``docs`` and return one row per document with the row of its group that stays. parts > 1 needs numeric ids."""
    if index:
        return annotated(docs, index, parts)
    own = DigestIndex(docs.sparkSession)
    try:
        return annotated(docs, own, parts)
    finally:
        own.drop()


def filter_docs(docs: DataFrame, index: DigestIndex | None = None, parts: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, index, parts).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.unhex("text_sha256").alias("__kept_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest"))
    return docs.withColumn("__digest", text_digest()).join(kept, same, "left_semi").select(docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, so that the second one meets an index that holds rows."""
    return exact_dedup(table(spark, sf_dir, "documents"), parts=2)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
