"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A five-word shingle weighs 1 + ln(its count in the text). Its arrivals form a Poisson process whose rate is its weight;
each arrival falls on a random register, which keeps the shingle of its first arrival. A shingle is dropped as soon as its
next arrival comes after every register's first one (early termination), so a text costs about its length plus M ln M
steps. Two signatures agree in a register with the probability Jaccard similarity J_P of the weighted texts.

Two texts are linked if their exact J_P is at least SIMILAR, or the Jaccard similarity of their shingle sets is: the second
also links texts that differ in how often they repeat a line. With all weights 1, J_P is that similarity. So a text that
repeats shingles has two signatures, one weighted and one with weights 1, and one that does not has one that is both. A
text's band keys are those of its signatures. Chance that a linked pair shares no band: (1 - s**ROWS)**BANDS at most, with
s the larger similarity: 6e-5 at 0.8 and 5e-8 at 0.85.

Texts with the same words are one node. Nodes that share a band of registers are candidates. First every node is
compared with its smallest bucket mate. Then, in buckets that still hold several groups, the nodes outside the
largest group are compared with a member of it, and all nodes with the bucket's centre, the text with the fewest
shingles of its own. Last, every node still outside is compared with all nodes of other groups, except where what
each lacks of the centre, and what it has besides, shows that the two cannot be similar in either way. So no pair that
shares a band goes unchecked unless it is connected already or cannot be a link. Classes are the connected components.

Defined results: a text without words (null, empty, punctuation) is alone in its class, as is its every row; texts of
one to four words have one shingle; texts of any length are compared whole; class_id is the smallest doc_id of a class and
that row stays; rows that repeat a doc_id with its text are the same document, those with another text are judged by their own; a row without doc_id is alone (class_id null) and stays;
other columns are ignored (``filter_docs`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, mix, raw, salted_join, slices, table, tidy
from .components import components
from .ngrams import word_bytes
from .shingles import weighted

SIMILAR, BANDS, ROWS = 0.8, 32, 6
M = BANDS * ROWS
#: Turns in which nodes outside a bucket's largest group are compared with one of its members, before the nearest text of the bucket takes its place.
STARS = 1
MAPS = [f"m{k}" for k in range(8)]
#: Before texts are fetched, pairs whose signatures agree in a smaller share of registers are left out: over 6 standard deviations under SIMILAR. Either kind of signature may agree.
SURE = 0.6


def probminhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, M] registers of texts given by (document, shingle hash, weight); registers of a text without shingles are 0."""
    when = np.full((n, M), np.inf)
    who = np.zeros(n * M, np.uint64)
    alone = np.bincount(doc, minlength=n) == 1
    who.reshape(n, M)[doc[alone[doc]]] = h[alone[doc], None]  # a single shingle takes every register
    go = ~alone[doc]
    doc, h, weight = doc[go], h[go], weight[go]
    flat, t, j = when.reshape(-1), np.zeros(len(doc)), 0
    limit = np.full(n, np.inf)
    while len(doc):
        j += 1
        r = mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        slot = doc * M + (mix(r) >> np.uint64(32)).astype(np.int64) * M // (1 << 32)
        soon = t < flat[slot]
        slot, ts, hs = slot[soon], t[soon], h[soon]
        np.minimum.at(flat, slot, ts)
        first = flat[slot] == ts
        who[slot[first]] = hs[first]
        live = doc[np.flatnonzero(np.diff(doc, prepend=-1))]
        limit[live] = when[live].max(1)
        on = t < limit[doc]
        doc, h, weight, t = doc[on], h[on], weight[on], t[on]
    return who.reshape(n, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """[n, BANDS] hashes of each band's registers and its number."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sig, heavy, bands): digest of the words, 16 bits of each register for weights 1 and for the counts' weights (null if
    no shingle repeats), band keys; fp is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n = batch.column("text"), batch.num_rows
            data, row = word_bytes(texts)
            cut = np.searchsorted(row, np.arange(n + 1)).tolist()
            whole = data.tobytes()
            doc, h, count = weighted(texts)
            some = np.bincount(doc, minlength=n) > 0
            fp = [hashlib.blake2b(whole[a:b], digest_size=16).digest() if ok else None for a, b, ok in zip(cut, cut[1:], some, strict=False)]
            reg = probminhash(doc, h, np.ones(len(h)), n)
            again = np.bincount(doc, weights=count > 1, minlength=n) > 0
            at, mine = np.cumsum(again) - 1, again[doc]
            more = probminhash(at[doc[mine]], h[mine], weights(count[mine]), int(again.sum()))
            short = lambda r: [x.tobytes() for x in (r >> np.uint64(48)).astype(np.uint16)]
            sig, extra = short(reg), short(more)
            heavy = [extra[i] if yes else None for i, yes in zip(at, again, strict=True)]
            keys, more_keys = band_keys(reg), band_keys(more)
            bands = [np.union1d(k, more_keys[i]) if yes else k for k, i, yes in zip(keys, at, again, strict=True)]
            off = np.concatenate([[0], np.cumsum([len(k) for k in bands])]).astype(np.int32)
            cols = [batch.column("doc_id"), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(heavy, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(bands)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "sig", "heavy", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInArrow(run, f"doc_id {kind}, fp binary, sig binary, heavy binary, bands array<long>")


def agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which one kind of signature agrees in at least SURE of the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb, ha, hb = (np.frombuffer(raw(batch.column(c))[0].tobytes(), np.uint16).reshape(-1, M) for c in ("sa", "sb", "ha", "hb"))
                yield batch.filter(pa.array(np.maximum((sa == sb).mean(1), (ha == hb).mean(1)) >= SURE)).select(["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"s{c}"), F.coalesce("heavy", "sig").alias(f"h{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "ha", "hb").mapInArrow(run, f"a {kind}, b {kind}")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets without repeats."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """What two signatures agree in on average: the sum over shared i of 1 / (sum over j of max(a_j / a_i, b_j / b_i))."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    x, y = wa[i], wb[j]
    # elements with a larger ratio x/y than i count as x_j / x_i, the others as y_j / y_i
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = wa.sum() - np.cumsum(x)
    below = wb.sum() - y.sum() + np.cumsum(y)
    return float((1 / (above / x + below / y)).sum())


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, each (distinct hashes, their counts), are linked."""
    if jaccard(a[0], b[0]) >= SIMILAR - 1e-12:
        return True
    repeats = (a[1] > 1).any() or (b[1] > 1).any()
    return bool(repeats) and probability_jaccard(a[0], weights(a[1]), b[0], weights(b[1])) >= SIMILAR - 1e-12


def shingled(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct hashes, their counts) of every text."""
    doc, h, count = weighted(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(h[a:b], count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(iter([big]), "tb"):
                ok = [similar(x, y) for x, y in zip(shingled(batch.column("ta")), shingled(batch.column("tb")), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def outlook(texts: DataFrame) -> DataFrame:
    """(doc_id, size, mass, own): distinct shingles of each text (doc_id, text), their weight, and how many of them no other of the texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, h, count = weighted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(weights(count))], ["doc_id", "h", "w"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    held = materialize(texts.mapInArrow(run, f"doc_id {kind}, h long, w double"), "held")
    single = held.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).filter("doc_id = last")
    own = single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    whole = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("mass"))
    return whole.join(own, "doc_id", "left").select("doc_id", "size", "mass", F.coalesce("own", F.lit(0)).alias("own"))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similar, outside, n_b, m0 ... m7) of every pair (a, b): whether it is a link, how many shingles of a are not in b, the size of b, and
    a 512-bit map of b's shingles that a lacks (several may share a bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(iter([big]), "tb"):
                parts = [shingled(batch.column(c)) for c in ("ta", "tb")]
                lacks = np.zeros((batch.num_rows, 512), np.uint8)
                for k, ((x, _), (y, _)) in enumerate(zip(*parts, strict=True)):
                    lacks[k, (np.setdiff1d(y, x, assume_unique=True) >> np.uint64(20)).astype(np.int64) & 511] = 1
                maps = np.packbits(lacks, axis=1).view(np.int64)
                ok = [similar(x, y) for x, y in zip(*parts, strict=True)]
                outside = [len(x) - len(np.intersect1d(x, y, assume_unique=True)) for (x, _), (y, _) in zip(*parts, strict=True)]
                cols = [batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_()), pa.array(outside, pa.int64()), pa.array([len(y) for y, _ in parts[1]], pa.int64()), *(pa.array(maps[:, k]) for k in range(8))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "similar", "outside", "n_b", *MAPS])

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, similar boolean, outside long, n_b long, " + ", ".join(f"{m} long" for m in MAPS))


def open_pairs(open_: DataFrame, seen: DataFrame, centre: DataFrame, near: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): all pairs of open rows (band, doc_id, grp, big) in a bucket that can be links, each in the first band it shares.

    seen: as of ``outlook``; centre: (band, b), a text for each bucket; near: every open text compared with its buckets' centres.
    What two texts share lies in the centre or outside of it. In the centre it is at most what neither of them lacks;
    outside it is at most what is not a text's own. Let x and y be the weights of what the first and the second do not share,
    X and Y those of all they have. Then J_P is at most 1 / (1 + x / (X - x) + y / (Y - y)), as 1 / (c / p + d / q) is concave
    in p and q; and x is at least the number of shingles that are not shared, as none weighs less than 1. With weights 1 that
    is the set similarity, and more weight only raises it, so one bound serves both. Pairs that cannot reach SIMILAR even so
    are left out, which leaves few pairs in a large group of almost similar texts.
    """
    sized = salted_join(open_.join(seen, "doc_id"), centre.withColumnRenamed("b", "centre"), ["band"], hot, ["doc_id"])
    near = near.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "outside", "n_b", *MAPS)
    sized = sized.join(near, ["doc_id", "centre"]).join(nodes.select("doc_id", "bands"), "doc_id")
    sized = materialize(sized.withColumn("free", F.greatest(F.lit(0), F.col("outside") - F.col("own"))), "sized")
    cols = ["doc_id", "grp", "size", "mass", "free", "bands", *MAPS]
    a = sized.filter("grp <> big").select("band", "n_b", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = sized.select("band", "big", *[F.col(c).alias(f"{c}_b") for c in cols])
    within = F.col("n_b")
    for m in MAPS:
        within = within - F.bit_count(F.col(f"{m}_a").bitwiseOR(F.col(f"{m}_b")))
    most = within + F.least("free_a", "free_b")
    apart = lambda c: F.greatest(F.lit(0), F.col(f"size_{c}") - most)
    loss = lambda c: F.try_divide(apart(c), F.col(f"mass_{c}") - apart(c))
    reach = (F.col("grp_a") != F.col("grp_b")) & ((F.col("grp_b") == F.col("big")) | (F.col("doc_id_a") > F.col("doc_id_b"))) & (most > 0) & (loss("a") + loss("b") <= 1 / SIMILAR - 1 + 1e-9)
    first = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")
    return salted_join(a, b, ["band"], hot, ["doc_id_a"]).filter(reach & first).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


@tidy("links")
def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): verified links between nodes (doc_id, sig, heavy, bands), enough of them to connect every class."""
    rows = materialize(nodes.select("doc_id", F.explode("bands").alias("band")), "bands")
    mates = materialize(rows.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("band", "low", "n"), "buckets")
    hot = materialize(hot_keys(mates, "band"), "hot-bands")
    full = materialize(salted_join(rows, mates.select("band", "low"), ["band"], hot, ["doc_id"]), "mates")
    # only documents with bucket mates are fetched from here on
    some = materialize(full.select("doc_id").distinct(), "candidates")
    texts = materialize(docs.select("doc_id", "text").join(some, "doc_id").dropDuplicates(["doc_id"]), "texts")
    sigs = nodes.select("doc_id", "sig", "heavy").join(some, "doc_id", "left_semi")

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs that are links; each only once, the larger id first."""
        once = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
        return materialize(verified(materialize(agreement(once, sigs), "agreeing"), texts), "links")

    def by_band(left: DataFrame, right: DataFrame, doc: str = "doc_id") -> DataFrame:
        """A join with one row for each band, in which large buckets are dealt out."""
        return salted_join(left, right, ["band"], hot, [doc])

    found = check(full.groupBy("doc_id").agg(F.min("low").alias("b")).filter("b < doc_id").select(F.col("doc_id").alias("a"), "b"))
    for turn in range(STARS + 2):
        roots = components(found)
        marked = full.select("band", "doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("grp"))
        marked = materialize(marked, "marked")
        sizes = marked.groupBy("band", "grp").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.groupBy("band").agg(F.max(F.struct("n", "grp")).alias("top"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
        mixed = materialize(top.select("band", F.col("top.grp").alias("big")), "mixed")
        if mixed.isEmpty():
            break
        open_ = materialize(by_band(marked, mixed), "open")
        outside = open_.filter("grp <> big").select("band", F.col("doc_id").alias("a"), F.col("grp").alias("ga"))
        if turn == STARS + 1:
            found = found.unionByName(check(open_pairs(open_, seen, centre, near, nodes, hot)))
            break
        if turn < STARS:  # a member of each bucket's largest group
            centre = open_.filter("grp = big").groupBy("band").agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(turn))).alias("b"))
            found = found.unionByName(check(by_band(outside, centre, "a").select("a", "b")))
        else:  # the text with the fewest shingles of its own is nearest to all others
            seen = materialize(outlook(texts.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")), "outlook")
            centre = materialize(open_.join(seen, "doc_id").groupBy("band").agg(F.min_by("doc_id", F.struct("own", "doc_id")).alias("b")), "centres")
            star = materialize(by_band(open_.select("band", F.col("doc_id").alias("a")), centre, "a").select("a", "b").distinct(), "pairs")
            near = materialize(compared(star, texts), "compared")
            found = found.unionByName(near.filter("similar AND a <> b").select("a", "b"))
    return found


@tidy("near-dedup")
def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept of every document; a doc_id, of any type that sorts, has one text."""
    sigs = materialize(signatures(docs), "signatures")
    copies = sigs.filter(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node"))
    copies = materialize(copies, "copies")
    nodes = materialize(sigs.filter(F.col("fp").isNotNull()).join(copies, "fp").filter("doc_id = node").dropDuplicates(["doc_id"]).select("doc_id", "sig", "heavy", "bands"), "nodes")
    found = links(nodes, docs)
    roots = components(found)
    ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = copies.join(roots, "node", "left").join(ends, "node", "left")
    classes = materialize(classes.select("fp", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    # one class row for each digest; digests of very many copies are dealt out
    worded = sigs.filter(F.col("fp").isNotNull()).select("doc_id", "fp")
    copied = materialize(hot_keys(worded.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp"), "hot-texts")
    known = salted_join(worded, classes, ["fp"], copied, ["doc_id"]).select("doc_id", "class_id", "n_links")
    wordless = sigs.filter(F.col("fp").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    no_id = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(wordless).unionByName(no_id).select("*", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text), and whether some doc_id has several texts: then the doc_id is a pair with the text's hash instead."""
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text_hash()).alias("low"), F.max(text_hash()).alias("high"))
    shared = not texts.filter("low <> high").limit(1).isEmpty()
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_hash().alias("text_hash")))
    return docs.select(key.alias("doc_id") if shared else "doc_id", "text"), shared


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (verified links of its text that were needed), kept of every document."""
    rows, shared = keyed(docs)
    found = classes_of(rows)
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("class_id.doc_id").alias("class_id"), "n_links", "kept") if shared else found


def filter_docs(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay (the smallest doc_id of each class), with all their columns."""
    rows, shared = keyed(docs)
    kept = classes_of(rows).filter("kept")
    if not shared:
        kept = kept.select(F.col("doc_id").alias("__kept_id"))
        return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__kept_id")), "left_semi")
    kept = kept.select(F.col("doc_id.doc_id").alias("__kept_id"), F.col("doc_id.text_hash").alias("__kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("doc_id").isNull() | (F.col("__hash") == F.col("__kept_hash")))
    return docs.withColumn("__hash", text_hash()).join(kept, same, "left_semi").select(docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
