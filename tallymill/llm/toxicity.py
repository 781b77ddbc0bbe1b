"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words and their byte n-grams (the space at either end included), all hashed. Embeddings of all
n-grams are averaged and fed to a two-class softmax; both layers are trained together by Adam. Unseen misspellings share
n-grams with known words. As the model is linear after averaging, scoring needs one number per bucket.

Toxic rows are few, and a model that knows its training rows by heart is too sure of them. So the training rows are scored by models that
have not seen them (FOLDS folds), the cut with the best F1 of these scores is found, and the final model, trained on all rows, has its bias moved so
that 0.5 is that cut.

Training sample: at most about TRAIN labelled rows of each class, chosen by a fixed hash of doc_id, whose
fold is not 0, and at most about TRAIN_BYTES of hashed bags (documented bounds on a fitted classifier). One task trains on these
bags, and the driver gets the finished weights only.

Defined results: a null or empty text has an empty bag and is scored by the bias alone, which training holds to class 0;
without training rows every score is 0.0; labels other than 0 and 1 are ignored; if a doc_id has several labels, all count;
rows that repeat a doc_id are scored each; a text of any length is scored whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash_below, materialize, ragged, raw, release, slices, table
from .ngrams import ngram_buckets, word_buckets, word_bytes

BITS, SIZES, DIM = 16, (4, 5, 6), 8
#: Rows of class 0 and 1 in the training sample, and bytes of their bags, at most about.
TRAIN, TRAIN_BYTES = (5000, 2500), 256 << 20
STEPS, BATCH, RATE, DECAY, FOLDS = 400, 128, 0.2, 1e-4, 3


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and n-gram."""
    data, doc = word_bytes(texts)
    parts = [word_buckets(data, doc, BITS), *(ngram_buckets(data, doc, n, BITS) for n in SIZES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


#: Zero vectors that every average also holds, so that a few n-grams alone do not decide.
NEUTRAL = 150


@dataclass(frozen=True)
class Bags:
    """The bags of many texts, one behind the other: bucket of each entry, its share in the text's average, entries of each text."""

    bucket: np.ndarray
    share: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, bucket: np.ndarray, count: np.ndarray, size: np.ndarray, total: np.ndarray) -> Bags:
        """total: n-grams of each text. Every 32nd text that training sees is an empty one, added here."""
        empty = np.zeros(-(-len(size) // 32), np.int64)
        return cls(bucket, (count / np.repeat(total + NEUTRAL, size)).astype(np.float32), np.concatenate([size, empty]))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, counted from 0, bucket, share) of the entries of the texts ``at``."""
        text, place = ragged(self.size[at])
        entry = (np.cumsum(self.size) - self.size)[at][text] + place
        return text, self.bucket[entry], self.share[entry]


def descend(bags: Bags, labels: np.ndarray, rows: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket for class 1 against 0, bias) after STEPS steps on the texts ``rows``. Embeddings [2**BITS, DIM] and softmax [DIM, 2] are
    trained together. With two classes the gradient of an embedding is a number times the difference of the softmax's columns."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    layers = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    sides, order = np.asarray([-1, 1], np.float32), np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        while len(order) < min(BATCH, len(rows)):
            order = np.concatenate([order, rng.permutation(rows)])
        at, order = order[:BATCH], order[BATCH:]
        text, bucket, share = bags.take(at)
        w = out @ sides
        z = np.bincount(text, weights=share * (emb @ w)[bucket], minlength=len(at)) + bias @ sides
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[at]) / len(at)
        g = np.bincount(bucket, weights=share * off[text], minlength=1 << BITS).astype(np.float32)
        grads = (g[:, None] * w + DECAY * emb, np.outer(emb.T @ g, sides), off.sum() * sides)
        rate = RATE * (1 - step / (STEPS + 1))
        for (p, m, v), grad in zip(layers, grads, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= rate / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return (emb @ (out @ sides)).astype(np.float32), float(bias @ sides)


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """Between the two scores where class 1 from there up has the best F1; above all scores if there is no class 1."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(labels[order])
    if not hits[-1]:
        return float(z[0]) + 1
    k = int((2 * hits / (np.arange(1, len(z) + 1) + hits[-1])).argmax())
    return float(z[k] + z[k + 1]) / 2 if k + 1 < len(z) else float(z[k]) - 1


@dataclass(frozen=True)
class SubwordModel:
    """weight: of each bucket for the class 1 against 0; bias."""

    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, bags: Bags, labels: np.ndarray) -> SubwordModel:
        """labels: of the texts that are not empty."""
        labels = np.concatenate([labels, np.zeros(len(bags.size) - len(labels), labels.dtype)])
        every = np.arange(len(labels))
        unseen = np.zeros(len(labels))
        for k in range(FOLDS):
            rest = every[every % FOLDS == k]
            others = every[every % FOLDS != k]
            if len(rest) and len(others):
                weight, bias = descend(bags, labels, others)
                text, bucket, share = bags.take(rest)
                unseen[rest] = np.bincount(text, weights=share * weight[bucket], minlength=len(rest)) + bias
        weight, bias = descend(bags, labels, every)
        return cls(weight, bias - best_cut(unseen, labels))

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, doc = bags(texts)
        n = np.bincount(doc, minlength=len(texts))
        z = np.bincount(doc, weights=self.weight[bucket], minlength=len(texts)) / (n + NEUTRAL) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> SubwordModel | None:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    rate = F.coalesce(*[F.when(F.col("y") == k, F.lit(TRAIN[k] / n)) for k, n in sizes.items()])
    sample = known.filter(hash_below(F.col("doc_id"), rate))  # at most about sum(TRAIN) small rows: small enough to broadcast

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, doc = bags(batch.column("text"))
            key, n = np.unique(doc << BITS | bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(batch.num_rows + 1) << BITS)
            total = np.bincount(doc, minlength=batch.num_rows)
            ids = [(key[a:b] & (1 << BITS) - 1).astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])]
            counts = [n[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("y"), pa.array(total), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["id", "y", "total", "ids", "counts"])

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("id", "y", "total", "ids", "counts")]).combine_chunks()
        ids, off = raw(rows.column("ids"))
        y, total = (rows.column(c).to_numpy() for c in ("y", "total"))
        bags = Bags.of(ids.view(np.uint16), raw(rows.column("counts"))[0].view(np.uint32), np.diff(off) // 2, total)
        del rows
        model = SubwordModel.fit(bags, y)
        release()
        return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": [model.bias]})

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.col("text").isNotNull())
    bagged = joined.mapInArrow(featurise, "id string, y int, total long, ids binary, counts binary").filter("total > 0")
    bagged = materialize(bagged, "bags")
    held = bagged.agg(F.sum(F.length("ids") + F.length("counts"))).first()[0] or 0
    if held > TRAIN_BYTES:
        bagged = bagged.filter(hash_below(F.concat(F.lit("bytes"), "id"), TRAIN_BYTES / held))
    model = bagged.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "weight binary, bias double").first()
    return SubwordModel(np.frombuffer(model["weight"], np.float32), model["bias"]) if model else None


def score(docs: DataFrame, model: SubwordModel | None, cutoff: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; reads doc_id and text only."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.score(batch.column("text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return chosen.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filter_docs(docs: DataFrame, model: SubwordModel | None, cutoff: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored under the cutoff, with all their columns (no shuffle)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(batch.column("text")) < cutoff))

    return docs.mapInArrow(keep, docs.schema) if model else docs


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
