"""Language identification: nearest of several TF-IDF centroids per language, with rejection by distance.

Texts become normalised TF-IDF vectors over hashed byte n-grams. Each language's training vectors are clustered by
spherical k-means; a text gets the language of the centroid with the largest cosine. A text farther from its
centroid than nearly all training members is marked as rejected.

Document frequencies are counted over all rows that may be learned from: those whose fold is not 0 and whose text and lang
are not null. The clustered sample (a documented bound on a fitted classifier) holds of these rows at most about
TRAIN_PER_LANG for each language, however many languages there are, and at most about TRAIN_ROWS in all, chosen by a fixed
hash of doc_id. A row is reduced to its n-grams' hashes and counts, at most 16 KB, before it reaches the driver.

Defined results: null text, or text without a letter: ``und``, score 0, rejected; with no training rows at all every
text is ``und``; rejected texts keep their nearest language unless ``reject_to_und``; ties go to the language that
sorts first; rows that repeat a doc_id are judged each by their own text, and all count in training; texts of any length
are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash_below, materialize, slices, table, tidy
from .ngrams import ngram_buckets, word_bytes

BITS, SIZES = 12, (1, 2, 3)
#: Training rows of a language and of all, about; and what each language keeps (all its rows if it has fewer), beyond the bound for all if need be.
TRAIN_PER_LANG, TRAIN_ROWS, LEAST_PER_LANG = 600, 12_000, 20
CENTROIDS, ROUNDS = 4, 8
#: A text is rejected if its cosine is under this quantile of its centroid's training members, less the margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.005, 0.1


def counts(texts: pa.Array) -> np.ndarray:
    """[texts, 2**BITS] n-gram counts."""
    data, doc = word_bytes(texts)
    out = np.zeros(len(texts) << BITS, np.float32)
    for n in SIZES:
        b, d = ngram_buckets(data, doc, n, BITS)
        out += np.bincount(d << BITS | b, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), 1 << BITS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Of n-grams that ``df`` of ``n`` texts hold."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


@dataclass(frozen=True)
class CentroidModel:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected, by centroid

    @classmethod
    def fit(cls, groups: Iterator[tuple[str, np.ndarray]], idf: np.ndarray, k: int = CENTROIDS) -> CentroidModel:
        """groups: (language, [rows, 2**BITS] counts), sorted by language; deterministic."""
        names, cents, least = [], [], []
        for lang, tf in groups:
            mine = unit(np.log1p(tf) * idf)
            c = unit(mine.mean(0))[None]
            while len(c) < min(k, len(mine)):  # next centre: the member farthest from the centres so far
                c = np.concatenate([c, mine[(mine @ c.T).max(1).argmin()][None]])
            for _ in range(ROUNDS):
                near = (mine @ c.T).argmax(1)
                c = unit(np.stack([mine[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
            cos = mine @ c.T
            near, top = cos.argmax(1), cos.max(1)
            for j in range(len(c)):
                if (near == j).any():
                    names.append(lang)
                    cents.append(c[j])
                    least.append(np.quantile(top[near == j], REJECT_QUANTILE) - REJECT_MARGIN)
        return cls(names, idf, np.stack(cents), np.asarray(least, np.float32))

    def predict(self, tf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each row."""
        cos = unit(np.log1p(tf) * self.idf) @ self.centroids.T
        at = cos.argmax(1)
        top = cos[np.arange(len(at)), at]
        return [self.langs[i] for i in at], np.clip(top, 0, 1).astype(np.float64), top < self.least[at]


def frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each n-gram, documents); one row for each n-gram reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)  # the last one counts documents
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 256):
                tf = counts(batch.column("text").slice(a, 256))
                df[:-1] += (tf > 0).sum(0)
                df[-1] += len(tf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["bucket", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in known.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def sample(known: DataFrame) -> list:
    """Rows (lang, id, ids, tf) of the training sample: n-gram hashes and their counts, sorted."""
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    # every language keeps its first rows, the rest of the bound is shared in proportion
    wanted, first = F.least("n", F.lit(TRAIN_PER_LANG)), F.least("n", F.lit(LEAST_PER_LANG))
    sums = sizes.agg(F.sum(wanted).alias("wanted"), F.sum(first).alias("first")).first()
    rest = (sums["wanted"] or 0) - (sums["first"] or 0)
    share = min(1.0, max(0, TRAIN_ROWS - (sums["first"] or 0)) / max(1, rest))
    rate = (first + (wanted - first) * share) / F.col("n")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                tf = np.minimum(counts(part.column("text")), 65535).astype(np.uint16)
                ids = [np.flatnonzero(x).astype(np.uint16) for x in tf]
                packed = [pa.array([x.tobytes() for x in each], pa.binary()) for each in (ids, [x[i] for x, i in zip(tf, ids, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("lang").cast(pa.string()), *packed], ["id", "lang", "ids", "tf"])

    # the languages' sizes are broadcast if they are few enough for Spark's own limit
    chosen = known.join(sizes, "lang").filter(hash_below(F.col("doc_id"), rate)).select("doc_id", "lang", "text")
    rows = [r for r in chosen.mapInArrow(featurise, "id string, lang string, ids binary, tf binary").collect() if r["ids"]]
    return sorted(rows, key=lambda r: (r["lang"], r["id"] or "", r["ids"], r["tf"]))


def train(docs: DataFrame) -> CentroidModel | None:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    rows = sample(known)
    if not rows:
        return None

    def groups() -> Iterator[tuple[str, np.ndarray]]:
        for lang, mine in itertools.groupby(rows, key=lambda r: r["lang"]):
            mine = list(mine)
            tf = np.zeros((len(mine), 1 << BITS), np.float32)
            for x, r in zip(tf, mine, strict=True):
                x[np.frombuffer(r["ids"], np.uint16)] = np.frombuffer(r["tf"], np.uint16)
            yield lang, tf

    return CentroidModel.fit(groups(), idf_of(*frequencies(known)))


def identify(docs: DataFrame, model: CentroidModel | None, reject_to_und: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; reads doc_id and text only."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                letter = pc.match_substring_regex(part.column("text").cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                if model is None:
                    langs, score, rejected = ["und"] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                else:
                    langs, score, rejected = model.predict(counts(part.column("text")))
                rejected = rejected | ~letter
                langs = [lang if ok and not (reject_to_und and no) else "und" for lang, ok, no in zip(langs, letter, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return chosen.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


@tidy("languages-found")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
