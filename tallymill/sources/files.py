"""Readers and writers of the engine's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import last_wins
from ..types import OCR


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Raw parquet files of one split, chosen by name."""
    return spark.read.option("pathGlobFilter", f"{split}*.parquet").parquet(folder)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines do not count, a missing path has no rows."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the place of each row (file, then order in it), for rules like "the last row wins"."""
    rows = read_jsonl(spark, path, schema)
    if not exists(spark, path):
        return rows.withColumn("file_pos", F.lit(None).cast("long"))
    # files are cut into splits, and splits dealt to tasks by size: the file and the split's start come first
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("file_pos", place)


def split_file(folder: str, split: str) -> str:
    """The file of a split; dev stands for validation."""
    return f"{folder.rstrip('/')}/{'validation' if split == 'dev' else split}.jsonl"


def read_gold(spark: SparkSession, folder: str, split: str, schema: str) -> DataFrame:
    return read_jsonl(spark, split_file(folder, split), schema)


def read_ocr(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One row for each id: of repeated ones the last of the file."""
    return last_wins(read_jsonl_ordered(spark, split_file(folder, split), OCR), "id", "file_pos").drop("file_pos")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else None


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else None


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All prediction files of a glob in one scan; the file's stem is the column ``stem``."""
    rows = read_jsonl(spark, glob, schema)
    if not exists(spark, glob):
        return rows.withColumn("stem", F.lit(None).cast("string"))
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl?)?$", 1))


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the file that sorts last."""
    last = runs.agg(F.max("stem").alias("stem"))
    return runs.join(F.broadcast(last), "stem")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sorted_jsonl(df: DataFrame, path: str, key: str = "id") -> None:
    """Overwrite with rows in key order over all files."""
    df.orderBy(key).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON text."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL."""
    return spark.sql(sql, args=params)
