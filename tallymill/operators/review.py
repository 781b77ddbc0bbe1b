"""Trace log and review queue as append-only event tables; the state is a view over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import REVIEW_EVENT, TRACE
from .ranks import with_rank
from .sets import last_wins
from .validate import with_validation

JSON_COLUMNS = ("output", "rules")


def log_traces(rows: DataFrame, path: str) -> None:
    """Append traces stamped with the current time; nested outputs and rules become JSON."""
    spark = rows.sparkSession
    fields = spark.createDataFrame([], TRACE).schema.fields
    cols = []
    for f in fields:
        if f.name == "ts":
            c = F.unix_micros(F.current_timestamp()) / 1e6
        elif f.name == "id":
            c = F.xxhash64(F.expr("uuid()")).bitwiseAND(F.lit((1 << 63) - 1))  # unique; newest first is by ts, then id
        elif f.name not in rows.columns:
            c = F.lit(None)
        elif f.name in JSON_COLUMNS and rows.schema[f.name].dataType.typeName() != "string":
            c = F.to_json(f.name)
        else:
            c = F.col(f.name)
        cols.append(c.cast(f.dataType).alias(f.name))
    rows.select(cols).write.mode("append").parquet(path)


def events(rows: DataFrame, kind: str, seq: Column, **values: Column) -> DataFrame:
    """Review events of one kind (added, resolved) with the columns of REVIEW_EVENT."""
    schema = rows.sparkSession.createDataFrame([], REVIEW_EVENT).schema
    have = {**{c: F.col(c) for c in rows.columns}, **values, "kind": F.lit(kind), "seq": seq}
    if kind == "added":
        have["status"] = F.lit("pending")
    return rows.select([have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def state(log: DataFrame) -> DataFrame:
    """Latest state of each review: what was added, and its last resolution."""
    added = last_wins(log.filter("kind = 'added'"), "review_id", "seq").drop("kind", "corrected", "status").withColumnsRenamed({"ts": "ts_created", "seq": "seq_created"})
    resolved = last_wins(log.filter("kind = 'resolved'").select("review_id", "seq", "ts", "corrected", "status"), "review_id", "seq").withColumnsRenamed({"ts": "ts_reviewed", "seq": "seq_reviewed"})
    return added.join(resolved, "review_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def by_status(reviews: DataFrame) -> DataFrame:
    return reviews.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")], F.count_if(F.col("status") != "pending").alias("done"))


def listed(reviews: DataFrame, status: str | None = None) -> DataFrame:
    """Reviews in the order they were added, all or those with one status."""
    return (reviews if status is None else reviews.filter(F.col("status") == status)).orderBy("seq_created", "review_id")


def placed(reviews: DataFrame, status: str | None = None) -> DataFrame:
    """Reviews with their place in that order, from 1; ranked in stretches, however many there are."""
    return with_rank(reviews if status is None else reviews.filter(F.col("status") == status), (), [F.col("seq_created"), F.col("review_id")], "place")


def not_queued(candidates: DataFrame, reviews: DataFrame, key: str = "receipt") -> DataFrame:
    return candidates.join(reviews.select(key), key, "left_anti")


def corrected(edits: DataFrame, receipt: str = "receipt") -> DataFrame:
    """Edited records without items that have no name, checked again."""
    items = F.filter(F.col(receipt)["items"], lambda x: F.trim(F.coalesce(x["name"], F.lit(""))) != "")
    clean = F.transform(items, lambda x: x.withField("quantity", F.nanvl(x["quantity"], F.lit(None).cast("double"))).withField("unit_price", F.nanvl(x["unit_price"], F.lit(None).cast("double"))).withField("line_total", F.nanvl(x["line_total"], F.lit(None).cast("double"))))
    return with_validation(edits.withColumn(receipt, F.col(receipt).withField("items", clean)), receipt)
