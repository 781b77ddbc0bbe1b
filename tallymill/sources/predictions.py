"""Prediction store: outputs of all runs in one table, partitioned by run, and writes that stop at too many failures.

A run is (split, system, model, prompt); each is a folder level, so a query that names runs, or joins a table of them, reads
only their files. A write that brings runs again replaces exactly these.

Defined results: a null part of a run's name is a value of its own; rows outside RUN's columns are kept as they are; an empty write changes nothing; a
store that does not exist yet has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..store import remove
from .files import exists

RUN = ("split", "system", "model", "prompt")


class ErrorBudgetExceeded(RuntimeError):
    """More rows failed than a job may have; ``failed`` and ``rows`` say how many."""

    def __init__(self, failed: int, rows: int, most: float):
        super().__init__(f"{failed} of {rows} rows failed, over {most:g} of them")
        self.failed, self.rows = failed, rows


def write_runs(rows: DataFrame, path: str) -> None:
    """Store the runs of ``rows`` (with the columns of RUN); those that are there are replaced, others stay."""
    names = rows.withColumns({c: F.col(c).cast("string") for c in RUN})
    # one task for each run and hash of its rows: few files, and no task with a whole run
    dealt = names.repartition(*RUN, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in RUN]), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored rows; schema: of the columns besides those of RUN."""
    whole = f"{schema}, " + ", ".join(f"`{c}` string" for c in RUN)
    return spark.read.schema(whole).parquet(path) if exists(spark, path) else spark.createDataFrame([], whole)


def of_runs(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of the runs listed in ``runs`` (columns of RUN; a list of runs is small): their partitions are found when the query runs.

    The optimizer prunes by plain equality and only for a list that is filtered: a null counts as a text of its own, and every run meets the filter."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    listed = runs.select(*[name(c).alias(f"__{c}") for c in RUN]).distinct().filter(F.col(f"__{RUN[0]}") >= "")
    same = reduce(lambda a, b: a & b, [name(c) == F.col(f"__{c}") for c in RUN])
    return stored.join(F.broadcast(listed), same, "left_semi")


def write_within_budget(rows: DataFrame, path: str, failed: Column, most: float) -> tuple[int, int]:
    """Write ``rows`` unless more than the share ``most`` of them failed; then nothing is left and the job stops. Gives (failed, rows).

    Rows are counted while they are written, so nothing is computed twice."""
    seen = Observation()
    counts = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))
    counts.write.mode("errorifexists").parquet(path)
    found = seen.get
    if found["failed"] > most * found["rows"]:
        remove(rows.sparkSession, path)
        raise ErrorBudgetExceeded(found["failed"], found["rows"], most)
    return found["failed"], found["rows"]
