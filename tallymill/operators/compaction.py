"""Review log with snapshots: the latest state without a replay of all events.

A log's folder holds ``log`` (appended files of events) and ``snapshots/N``: ``covered``, the names of the log's files that the snapshot holds, and ``rows``,
the events that still decide: of each review the last one of each kind. ``rows`` is written last; a snapshot without it does not count, so a
compaction that breaks off changes nothing and can be repeated. The events that count now are the last snapshot's rows and those of the
files it does not cover; late events, with numbers lower than others that were compacted, are among them.

Defined results: state and places equal those of a full replay after any number of compactions; of events of one review, kind and number the one that sorts
last as a row counts; a log without events has no rows; compacting without new files does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove
from ..types import REVIEW_EVENT
from . import review

KEYS = ("review_id", "kind")


class EventLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def _snapshot(self) -> int | None:
        """The number of the last complete snapshot."""
        done = [int(n) for n in self._names("snapshots") if "_SUCCESS" in self._names(f"snapshots/{n}/rows")]
        return max(done, default=None)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(REVIEW_EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], REVIEW_EVENT)

    def _parts(self) -> tuple[int | None, set[str], list[str]]:
        """(last snapshot, files it covers, files it does not)."""
        last = self._snapshot()
        covered = {r["name"] for r in self.spark.read.parquet(f"{self.path}/snapshots/{last}/covered").collect()} if last is not None else set()
        return last, covered, [n for n in self._names("log") if n.endswith(".parquet") and n not in covered]

    def append(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(f"{self.path}/log")

    def events(self) -> DataFrame:
        """The events that still decide, and all later ones."""
        last, _, fresh = self._parts()
        return self._read(([f"{self.path}/snapshots/{last}/rows"] if last is not None else []) + [f"{self.path}/log/{n}" for n in fresh])

    def state(self) -> DataFrame:
        return review.state(deciding(self.events()))

    def compact(self) -> bool:
        """Write a snapshot if there are new events. Readers of the one before are not disturbed."""
        last, covered, fresh = self._parts()
        if not fresh:
            return False
        target = f"{self.path}/snapshots/{0 if last is None else last + 1}"
        remove(self.spark, target)  # what a compaction that broke off has left
        names = self.spark.createDataFrame([(n,) for n in sorted(covered | set(fresh))], "name string")
        names.coalesce(1).write.parquet(f"{target}/covered")
        deciding(self.events()).write.parquet(f"{target}/rows")
        return True

    def vacuum(self) -> int:
        """Delete covered files and earlier snapshots (once nobody reads them); gives the number of files."""
        last, covered, _ = self._parts()
        gone = [n for n in self._names("log") if n in covered]
        for n in self._names("snapshots"):
            if last is not None and int(n) < last:
                remove(self.spark, f"{self.path}/snapshots/{n}")
        for n in gone:
            remove(self.spark, f"{self.path}/log/{n}")
        return len(gone)


def deciding(events: DataFrame) -> DataFrame:
    """Of each review the last event of each kind: a partial aggregate, so reviews with very many events are combined before the shuffle."""
    cols = [c for c in events.columns if c not in KEYS]
    best = events.groupBy(*KEYS).agg(F.max(F.struct("seq", *[c for c in cols if c != "seq"])).alias("x"))
    return best.select(*KEYS, *[F.col("x")[c].alias(c) for c in cols]).select(events.columns)
