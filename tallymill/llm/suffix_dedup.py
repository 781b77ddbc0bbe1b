"""Exact removal of repeated byte strings with suffix arrays, partitioned by content anchors.

Every window of LENGTH bytes is assigned to its anchor: the K bytes in it with the least hash (the first of equals).
Equal windows have equal anchors, so windows can be compared anchor by anchor, wherever they stand. Consecutive
windows of one document with one anchor form a run; a run's text is LENGTH bytes longer than its last window's
start. The steps:

1. hash the anchors of all runs and count them; an anchor that occurs once has no repeated window;
2. give documents their repeated anchors back and cut out the runs that have them, equal runs counted together;
3. send runs to tasks by anchor, sort their suffixes in two stages (see suffix_array), and mark the windows whose
   common prefix with a neighbour reaches LENGTH, or whose run occurs more than once;
4. give the marks back to the documents and remove the union of the marked windows.

An anchor with more than SPLIT different runs (a passage in a large share of all documents, in different
surroundings) is dealt to several tasks by run. Each sorts its own suffixes; windows of such anchors are also
compared across these tasks, by 128-bit digest, summed before the shuffle.

Defined results: null counts as the empty text; every row is a place of its own, so rows that repeat a document
repeat all its windows; texts under LENGTH bytes stay whole; texts of any length are searched whole; other columns are ignored (``filter_docs`` keeps them);
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_dedup import cut_out
from .common import materialize, raw, release, slices, table, tidy
from .suffix_array import Suffixes, prefix_sums, window_hash

LENGTH, K = 200, 64
#: Runs of an anchor that one task sorts together (about a megabyte of them); bytes of runs that are sorted together; bytes of runs counted together in a task.
SPLIT, SORT_BYTES, COMBINE_BYTES = 4096, 1 << 19, 16 << 20
#: What identifies a row's text: null-safe keys for joins.
KEY = ["doc_id", "t1"]


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, past last window, anchor's hash) of every run."""
    n = len(data)
    size = np.diff(off)
    long = np.flatnonzero(size >= LENGTH)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none.view(np.uint64)
    h = prefix_sums(data)
    at = np.arange(n - K + 1)
    grams = window_hash(h, slice(0, n - K + 1), slice(K, n + 1))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties: the first place
    span, width = LENGTH - K + 1, 1
    while width < span:  # least of the next `width` grams, doubled until it spans a window
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    counts = size[long] - LENGTH + 1
    doc = np.repeat(long, counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(off[long], counts)
    anchor = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return doc[first], window[first], window[last] + 1, grams[anchor[first]]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), "text")


def same_row(left: DataFrame, right: DataFrame):
    """Null-safe equality of KEY."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["t1"] == right["t1"])


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, h, n): anchors of every document and in how many of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, _, _, h = runs(*raw(batch.column("text")))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            rows = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("t1").take(rows), pa.array(h[at].view(np.int64)), pa.array(np.diff(at, append=len(h)))], ["doc_id", "t1", "h", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, t1 long, h long, n long")


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def cut_runs(docs: DataFrame) -> DataFrame:
    """From (doc_id, t1, text, hs): places (doc_id, t1, at, d1, d2) of the runs with anchors hs, and, with a null ``at``, the different runs (h, d1, d2, n, body) of the task."""
    names = ["doc_id", "t1", "at", "h", "d1", "d2", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        bytes_held, kind = 0, None

        def bodies() -> pa.RecordBatch:
            d = halves([k[1] for k in held])
            cols = [pa.nulls(len(held), kind), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array([k[0] for k in held], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])]
            cols += [pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in slices(batches):
            kind = batch.column("doc_id").type
            data, off = raw(batch.column("text"))
            doc, a, b, h = runs(data, off)
            flat = batch.column("hs").flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("hs").value_lengths()))
            want = np.unique(np.stack([owner.astype(np.uint64), flat], 1), axis=0).view([("o", np.uint64), ("h", np.uint64)]).ravel()
            mine = np.stack([doc.astype(np.uint64), h], 1).copy().view([("o", np.uint64), ("h", np.uint64)]).ravel()
            on = np.flatnonzero(np.isin(mine, want))
            whole, digests = data.tobytes(), []
            for i, j, g in zip(a[on].tolist(), (b[on] + LENGTH - 1).tolist(), h[on].view(np.int64).tolist(), strict=True):
                body = whole[i:j]
                d = hashlib.blake2b(body, digest_size=16).digest()
                digests.append(d)
                if (g, d) in held:
                    held[g, d][0] += 1
                else:
                    held[g, d] = [1, body]
                    bytes_held += len(body) + 200
            rows, d = pa.array(doc[on]), halves(digests)
            n = len(on)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("t1").take(rows), pa.array(a[on] - off[doc[on]]), pa.nulls(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names
            )
            if bytes_held > COMBINE_BYTES:
                yield bodies()
                bytes_held = 0
        if held:
            yield bodies()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, t1 long, at long, h long, d1 long, d2 long, n long, body binary")


def sorted_runs(bodies: DataFrame) -> DataFrame:
    """From (h, parts, d1, d2, n, body), grouped by h: (d1, d2, spans, w1, w2, window). Rows with spans mark a run's repeated windows as
    [first, past last, ...]; rows with a window give the digests of the windows of anchors that are split over tasks."""
    names = ["d1", "d2", "spans", "w1", "w2", "window"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bool]]:
        """Different runs (d1, d2, n, body, split) in portions that hold anchors whole."""
        held: dict[tuple[int, int, int], list] = {}
        size, last = 0, None
        for batch in batches:
            for h, parts, d1, d2, n, body in zip(*(batch.column(c).to_pylist() for c in ("h", "parts", "d1", "d2", "n", "body")), strict=True):
                if h != last and size > SORT_BYTES:
                    yield list(held.values())
                    held, size = {}, 0
                last = h
                if (h, d1, d2) in held:
                    held[h, d1, d2][2] += n
                else:
                    held[h, d1, d2] = [d1, d2, n, body, parts is not None]
                    size += len(body)
        if held:
            yield list(held.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            size = np.asarray([len(x[3]) for x in part])
            marks = Suffixes(np.frombuffer(b"".join(x[3] for x in part), np.uint8), size, LENGTH).repeated()
            start = np.cumsum(size) - size
            for i in np.flatnonzero(np.asarray([x[2] for x in part]) > 1):
                marks[start[i] : start[i] + size[i] - LENGTH + 1] = True
            edge = np.diff(marks.astype(np.int8), prepend=0, append=0)
            a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)  # windows end before their run does, so no span joins two runs
            row = np.searchsorted(start, a, "right") - 1
            new = np.flatnonzero(np.diff(row, prepend=-1))
            flat = np.stack([a - start[row], b - start[row]], 1).reshape(-1).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32) * 2), pa.array(flat))
            n, at = len(new), row[new]
            void = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part[i][0] for i in at], pa.int64()), pa.array([part[i][1] for i in at], pa.int64()), spans, void, void, pa.nulls(n, pa.int32())], names)
            seen = set()  # equal windows of this portion are marked already: one of them stands for all
            for d1, d2, _, body, split in part:
                if split:
                    all_ = {hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest(): i for i in range(len(body) - LENGTH + 1)}
                    new = [(d, i) for d, i in all_.items() if d not in seen]
                    seen.update(all_)
                    k, w = len(new), halves([d for d, _ in new])
                    yield pa.RecordBatch.from_arrays([pa.array([d1] * k, pa.int64()), pa.array([d2] * k, pa.int64()), pa.nulls(k, spans.type), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array([i for _, i in new], pa.int32())], names)
            release()

    return bodies.mapInArrow(run, "d1 long, d2 long, spans array<int>, w1 long, w2 long, window int")


@tidy("repeats")
def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, spans): for documents with repeated windows, their first bytes as a list of [first, past last, ...] lists. docs: as of ``keyed``."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = materialize(anchors(docs), "anchors")
    shared = materialize(mine.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "shared-anchors")
    # an anchor that very many documents hold is split by adaptive execution
    hits = mine.select("doc_id", "t1", "h").join(shared.hint("merge"), "h")
    hits = hits.groupBy("doc_id", "t1").agg(F.collect_set("h").alias("hs"))
    wanted = docs.join(hits.hint("merge"), same_row(docs, hits)).select(docs["doc_id"], docs["t1"], docs["text"], hits["hs"])
    cut = materialize(cut_runs(wanted), "runs")
    places = cut.filter(F.col("at").isNotNull()).select(*KEY, "at", "d1", "d2")
    bodies = cut.filter(F.col("at").isNull()).select("h", "d1", "d2", "n", "body")
    wide = materialize(bodies.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > SPLIT).select("h", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")), "split-anchors")
    bodies = bodies.join(wide.hint("merge"), "h", "left") if wide.limit(1).count() else bodies.withColumn("parts", F.lit(None).cast("int"))
    dealt = bodies.withColumn("part", F.coalesce(F.pmod("d1", "parts"), F.lit(0)))
    found = materialize(sorted_runs(dealt.repartition(tasks, "h", "part").sortWithinPartitions("h", "part").select("h", "parts", "d1", "d2", "n", "body")), "marks")
    marks = found.filter(F.col("spans").isNotNull()).select("d1", "d2", "spans")
    # windows of split anchors: repeated if two different runs hold them
    windows = found.filter(F.col("window").isNotNull()).select("w1", "w2", "d1", "d2", "window")
    again = materialize(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"), "split-windows")
    across = windows.join(again.hint("merge"), ["w1", "w2"]).select("d1", "d2", F.array("window", F.col("window") + 1).alias("spans"))
    marks = materialize(marks.unionByName(across).groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "run-marks")
    known = places.join(marks.hint("merge"), ["d1", "d2"])
    return known.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("at"), F.col("spans"))).alias("marks"))


def spans_of(marks: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal byte spans that the marked windows of a text cover."""
    if not marks:
        return []
    a = np.concatenate([np.asarray(m["spans"][0::2], np.int64) + m["at"] for m in marks])
    b = np.concatenate([np.asarray(m["spans"][1::2], np.int64) + m["at"] for m in marks]) + LENGTH - 1
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def with_marks(docs: DataFrame) -> DataFrame:
    """docs with the columns t1 and marks."""
    mine = docs.withColumn("t1", F.xxhash64("text"))
    found = repeats(keyed(docs))
    return mine.join(found.hint("merge"), same_row(mine, found), "left").select(*[mine[c] for c in mine.columns], found["marks"])


@tidy("suffix-dedup")
def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = raw(batch.column("text"))
            whole, rows = data.tobytes(), []
            for a, b, marks in zip(off[:-1].tolist(), off[1:].tolist(), batch.column("marks"), strict=True):
                spans = spans_of(marks.as_py(), b - a)
                rows.append((b - a, sum(y - x for x, y in spans), len(spans), hashlib.sha256(cut_out(whole[a:b], spans)).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_marks(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def filter_docs(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` lacks the removed bytes (characters that a span cuts in two go as a whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks"), strict=True):
                body = (text or "").encode()
                spans = spans_of(marks.as_py(), len(body))
                out.append(cut_out(body, spans).decode("utf-8", "ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    marked = with_marks(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "text", "marks")
    cleaned = marked.mapInArrow(run, T.StructType([marked.schema["row"], T.StructField("text", T.StringType())]))
    return cleaned.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
