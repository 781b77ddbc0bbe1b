"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []
_scope: contextvars.ContextVar[list[str]] = contextvars.ContextVar("scope", default=_kept)


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tallymill-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of this process, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or _own_dir()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder. Deleted with the scope around it, or when this process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scope.get().append(path)
    return path


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors; lasts like ``folder``. options: of the writer."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The tables kept inside, by their folders; ``drop`` them once nothing reads them."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        remove(spark, paths.pop())


@atexit.register
def _remove_kept() -> None:
    spark = SparkSession.getActiveSession()
    for path in _kept if spark else ():
        with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
            remove(spark, path)
