"""Corpus pipeline: five stages over the documents table, each reading what its predecessor kept.

Order: toxicity, exact dedup, near dedup, benchmark decontamination, packing. All but the last return the columns
of documents; the last returns one row per packed piece. Rows with null or empty texts pass the filters (null and
empty texts are equal, so one of them stays); extra columns are carried through the filtering stages. Rows that repeat a doc_id with its text
stay or go together, rows that share an id are judged by their own text; ties go to the largest doc_id among equal texts and to the
smallest among near copies; texts of any length are read whole; empty tables give no rows. Each stage's table is deleted once the next has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from tallymill.llm.common import materialize, table
from tallymill.store import drop, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labelled documents, does not reject."""
    return toxicity.filter_docs(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.filter_docs(docs, parts=2)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the smallest doc_id."""
    return near_dedup.filter_docs(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.filter_docs(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifier, near-duplicate classes and packing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        result = made.pop()
        drop(spark, [*made, *before])  # what the stage read and made is not needed any more
        before = [result]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # written out, so its input can go
    drop(spark, before)
    return packed
