"""Scored rows that are kept between jobs: only what is new or changed is scored.

A row's input (prediction, gold and error) has a digest; what is stored under (system, id, digest) is not scored again. The
stored table is partitioned by a hash of the id, so a later read or anti-join on ids stays with its partition.

Defined results: the result for ``rows`` equals scoring them all, rows that repeat an input included (once each); inputs that are not among ``rows`` any more
stay stored and do not count; other settings need another folder; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.files import exists
from .score import evaluate

INPUT, KEYS = ("pred", "gold", "error"), ("system", "id", "input_digest")


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("input_digest", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in INPUT]))


def not_among(keyed: DataFrame, there: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose KEYS are not among those of ``there``. What an id has there comes to its rows as one short list, by hash: rows that are already dealt by id, whole records,
    are neither dealt nor sorted again. A null key is among none."""
    known = there.groupBy("id").agg(F.collect_set(F.struct("system", "input_digest")).alias("__known"))
    same = F.col("system").isNotNull() & F.array_contains("__known", F.struct("system", "input_digest"))
    return keyed.join(known.hint("shuffle_hash"), "id", "left").filter(~F.coalesce(same, F.lit(False))).select(keyed.columns)


def scored(rows: DataFrame, path: str, settings: Settings) -> tuple[DataFrame, int]:
    """(scores of ``rows`` (system, id, pred, gold, error), how many of them were new): new inputs are scored and appended to the table in ``path``."""
    spark = rows.sparkSession
    keyed = with_digest(rows.select("system", "id", *INPUT))
    there = spark.read.parquet(path).select(*KEYS) if exists(spark, f"{path}/_SUCCESS") else None
    new = (keyed if there is None else not_among(keyed, there)).dropDuplicates(list(KEYS))
    before = 0 if there is None else there.count()
    evaluate(new, settings).drop(*INPUT).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    wanted = keyed.select(*KEYS)
    return wanted.join(stored, list(KEYS)), stored.count() - before
