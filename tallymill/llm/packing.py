"""Sequence packing along a space-filling curve.

Each document's tokens become a signed random projection of its hashed token counts; the few coordinates give a
Hilbert key. Documents are range-sorted by that key, and neighbours along the curve share sequences. Whole
sequences that one document fills by itself are cut at once; only what is left over (less than one sequence a
document) travels along the curve. A partition's last tokens are cut into powers of two, so nothing is padded.

Defined results: a null or empty text is the end token alone; ties on the key are ordered by doc_id and start;
repeated rows are packed each; one text of any length yields its pieces in batches; extra columns are ignored; an
empty table gives no rows; special strings inside texts become their special ids, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy

SEQUENCE, END, DIMS, LEVELS, HASHED = 1024, 0, 4, 12, 1 << 12
#: Coordinates are divided by this before the logistic function spreads them over the grid.
SPREAD = 0.12


@functools.cache
def encoder(path: str):
    """An encoder with the ids of the byte-level BPE file at ``path``; its merges are applied by the tiktoken library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    others = [b for b in range(256) if b not in visible]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def directions() -> np.ndarray:
    return np.random.default_rng(3).choice(np.asarray([-1, 1], np.float32), (HASHED, DIMS))


def project(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[documents, DIMS] coordinates in [0, 1) of ragged token ids."""
    bins = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    out = np.stack([np.bincount(doc, weights=directions()[bins, k], minlength=len(lengths)) for k in range(DIMS)], 1)
    return 1 / (1 + np.exp(-np.clip(out / np.maximum(lengths, 1)[:, None] / SPREAD, -30, 30)))


def hilbert(points: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Hilbert key of points in [0, 1]^d: undo the curve's reflections and exchanges level by level, then interleave the bits."""
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    d = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] >> b) & 1)
    return key


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_bytes(enc) -> int:
    """Bytes of an id on its way along the curve."""
    return 4 if enc.n_vocab > 1 << 16 else 2


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, key, full, crc, ids): whole sequences have their crc, what is left over has its ids (2 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            each = [np.asarray([*enc.encode(t or "", allowed_special="all"), END], np.int64) for t in batch.column("text").to_pylist()]
            lengths = np.asarray([len(x) for x in each], np.int64)
            key = hilbert(project(np.concatenate(each), lengths))
            row, start, full, check, rest = [], [], [], [], []
            for i, ids in enumerate(each):
                whole = len(ids) // SEQUENCE * SEQUENCE
                for a in range(0, len(ids), SEQUENCE):
                    row.append(i)
                    start.append(a)
                    full.append(a < whole)
                    check.append(crc(ids[a : a + SEQUENCE]) if a < whole else None)
                    rest.append(None if a < whole else ids[a:].astype(f"<u{id_bytes(enc)}").tobytes())
            row, start = np.asarray(row), np.asarray(start, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(np.minimum(SEQUENCE, lengths[row] - start)), pa.array(lengths[row]), pa.array(key[row]), pa.array(full), pa.array(check, pa.int64()), pa.array(rest, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "key", "full", "ids_crc32", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, key long, full boolean, ids_crc32 long, ids binary")


@tidy("packed")
def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, path), "pieces")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = id_bytes(encoder(path))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequence numbers count from 0 within the task; its pieces come in curve order."""
        seq, room, held = 0, SEQUENCE, []  # held: pieces of the sequence being filled

        def flush(held: list[tuple], names: list[str]) -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, *[pa.int64()] * 7), strict=True)], names)

        names, id_type, out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"], None, []
        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, start, tokens, key, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "key", "ids")), strict=True):
                ids, at = np.frombuffer(data, f"<u{wide}"), 0
                while at < len(ids):
                    n = min(room, len(ids) - at)
                    held.append((doc, start + at, ids[at : at + n], tokens, seq, SEQUENCE - room, key))
                    at, room = at + n, room - n
                    if not room:
                        out += [(d, s, len(x), crc(x), t, q, o, k) for d, s, x, t, q, o, k in held]
                        seq, room, held = seq + 1, SEQUENCE, []
            if out:
                yield flush(out, names)
                out = []
        left = SEQUENCE - room  # cut into powers of two
        size = offset = 0
        for d, s, x, t, _, _, k in held:
            at = 0
            while at < len(x):
                if offset == size:
                    size, offset, seq, left = 1 << left.bit_length() - 1, 0, seq + bool(size), left - (1 << left.bit_length() - 1)
                n = min(size - offset, len(x) - at)
                out.append((d, s + at, n, crc(x[at : at + n]), t, seq, offset, k))
                at, offset = at + n, offset + n
        if out:
            yield flush(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
    rest = pieces.filter(~F.col("full")).select("doc_id", "start", "doc_tokens", "key", "ids")
    # doc_id and start split what shares a key, so that one large group of copies does not meet in one task
    rest = rest.repartitionByRange(tasks, "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    packed = rest.mapInArrow(along, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")
    task = F.spark_partition_id().cast("long")
    # ids: even for packed sequences, odd for those that one document fills; the task's number is in the high bits
    packed = packed.withColumn("sequence_id", F.shiftleft(task, 40) + F.col("sequence_id") * 2)
    alone = pieces.filter("full").withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*names).unionByName(alone.withColumnRenamed("key", "curve_key").select(*names))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
