"""Greedy one-to-one matching of predicted and gold items inside a record, without a shuffle."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.names import ascii_or_normal, flat, norm_name, numbered
from ..functions.text import characters
from ..types import PAIR

NAME_THRESHOLD, PRICE_TOL = 0.6, 0.5


def similar_items(left: pa.Array, right: pa.Array, threshold: float) -> tuple[np.ndarray, ...]:
    """(row, i, j, sim) of all pairs of names in two arrays of lists (``ascii_or_normal``) with at least the threshold, by row, i, then j. A batch's different
    pairs of names, less those that their lengths rule out, are compared at once (``functions.lcs``); as an expression that is quadratic in the names' lengths."""
    (row_p, ps), (row_g, gs) = flat(left), flat(right)
    known, (p, g) = numbered(ps, gs, normal=False)
    n = len(left)
    n_p, n_g = np.bincount(row_p, minlength=n), np.bincount(row_g, minlength=n)
    first_p, first_g = np.cumsum(n_p) - n_p, np.cumsum(n_g) - n_g
    # every item of one side beside every item of the other, record by record
    item = np.repeat(np.arange(len(p)), n_g[row_p])
    row = row_p[item]
    j = np.arange(len(item)) - np.repeat(np.cumsum(n_g[row_p]) - n_g[row_p], n_g[row_p])
    a, b = p[item], g[first_g[row] + j]
    ok = 2 * np.minimum(known.size[a], known.size[b]) >= threshold * (known.size[a] + known.size[b])
    item, row, j, a, b = (x[ok] for x in (item, row, j, a, b))
    different, at = np.unique(a * np.int64(len(known.names) + 1) + b, return_inverse=True)
    sim = known.similarity(different // (len(known.names) + 1), different % (len(known.names) + 1))[at]
    ok = sim >= threshold
    return row[ok], (item - first_p[row])[ok], j[ok], sim[ok]


def listed(n: int, row: np.ndarray, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> pa.Array:
    """The pairs of each of n rows as a list."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sim)], ["i", "j", "sim"])
    return pa.ListArray.from_arrays(ends, found)


@functools.cache
def similar_pairs(threshold: float):
    """Arrow UDF over arrays of names: ``similar_items`` of each row."""

    @F.arrow_udf(f"array<{PAIR}>")
    def pairs(left: pa.Array, right: pa.Array) -> pa.Array:
        return listed(len(left), *similar_items(left, right, threshold))

    return pairs


def candidates(pred: Column, gold: Column, threshold: float = NAME_THRESHOLD) -> Column:
    """All (i, j, sim) of items with similar names."""
    return similar_pairs(threshold)(ascii_or_normal(pred["name"]), ascii_or_normal(gold["name"]))


def priced(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``money_equal`` within PRICE_TOL, which calls an amount that is not finite near to any other."""
    x, y = (c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in (a, b))
    no_x, no_y = (c.is_null().to_numpy(zero_copy_only=False) for c in (a, b))
    with np.errstate(invalid="ignore"):
        near = (np.abs(x - y) <= PRICE_TOL) | ~np.isfinite(x) | ~np.isfinite(y)
    return np.where(no_x | no_y, no_x & no_y, near)


def greedy(row: np.ndarray, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs those taken, by row: best similarity first, ties by the larger i, then the larger j; each item once. The k-th best pairs of all rows are
    looked at together."""
    order = np.lexsort((-j, -i, -sim, row))
    row, i, j, sim = row[order], i[order], j[order], sim[order]
    # each row's items of either side have a number
    (_, p), (_, g) = (np.unique(row * np.int64(x.max(initial=0) + 1) + x, return_inverse=True) for x in (i, j))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(first, append=len(row))
    first, size = first[np.argsort(-size, kind="stable")], np.sort(-size)  # rows with pairs left come first
    free_p, free_g, taken = np.ones(len(row), bool), np.ones(len(row), bool), np.zeros(len(row), bool)
    for k in range(int(-size.min(initial=0))):
        at = first[: np.searchsorted(size, -k)] + k
        at = at[free_p[p[at]] & free_g[g[at]]]
        taken[at] = True
        free_p[p[at]] = free_g[g[at]] = False
    return row[taken], i[taken], j[taken], sim[taken]


@functools.cache
def matched_pairs(threshold: float):
    """Arrow UDF over the names (``ascii_or_normal``) and line totals of both sides' items: the greedy pairs of similar names whose line totals agree as
    well, and those of similar names alone."""

    @F.arrow_udf(f"struct<pairs:array<{PAIR}>,name_pairs:array<{PAIR}>>")
    def matched(left: pa.Array, right: pa.Array, left_totals: pa.Array, right_totals: pa.Array) -> pa.Array:
        row, i, j, sim = similar_items(left, right, threshold)
        (row_p, ps), (row_g, gs) = flat(left_totals), flat(right_totals)
        first_p, first_g = (np.searchsorted(x, row) for x in (row_p, row_g))
        ok = priced(ps.take(pa.array(first_p + i)), gs.take(pa.array(first_g + j)))
        both = greedy(row[ok], i[ok], j[ok], sim[ok]), greedy(row, i, j, sim)
        return pa.StructArray.from_arrays([listed(len(left), *x) for x in both], ["pairs", "name_pairs"])

    return matched


def matches(pred: Column, gold: Column, threshold: float = NAME_THRESHOLD) -> Column:
    """(pairs, name_pairs) of two arrays of items: matched by price and name, and by name."""
    return matched_pairs(threshold)(ascii_or_normal(pred["name"]), ascii_or_normal(gold["name"]), pred["line_total"], gold["line_total"])


#: Symbols of normal names, and how many of each have a bit of their own.
SYMBOLS, REPEATS, WORD = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 5, 62
MAPS = [f"m{k}" for k in range(-(-len(SYMBOLS) * REPEATS // WORD))]


@F.arrow_udf(DoubleType())
def pair_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity of two columns of normal names, each batch at once."""
    known, (x, y) = numbered(a, b)
    return pa.array(known.similarity(x, y))


def letter_maps(letters: Column) -> dict[str, Column]:
    """The counts of a name's letters as bits, the k-th A being a bit of its own, and how many letters have none."""
    place = lambda x: F.instr(F.lit(SYMBOLS), F.substring(x, 1, 1)) - 1
    which = lambda x: F.substring(x, F.lit(2), F.length(x)).cast("int") - 1
    bits = F.transform(F.filter(letters, lambda x: (place(x) >= 0) & (which(x) < REPEATS)), lambda x: place(x) * REPEATS + which(x))
    add = lambda k: lambda done, bit: done.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit - k * WORD))
    mine = lambda k: F.filter(bits, lambda x: F.floor(x / WORD) == k)
    own = {m: F.aggregate(mine(k), F.lit(0).cast("long"), add(k)) for k, m in enumerate(MAPS)}
    return own | {"extra": F.size(letters) - F.size(bits)}


#: From this similarity on, names are joined on what they have in common. A name has at most SHORTENED forms for each length of the other name, and
#: fewer letters than LONGEST.
SHORTEN_FROM, SHORTENED, LONGEST = 0.8, 1500, 1024
#: Forms hashed at once.
FORMS = 1 << 19


def common_letters(m: int, n: int, least: float) -> int:
    """How long a common subsequence names of m and n letters need."""
    return math.ceil(least * (m + n) / 2 - 1e-9)


def shortened(m: int, n: int, least: float) -> bool:
    """Whether names of m and n letters, if they can be similar, are found by their shortened forms."""
    k = common_letters(m, n, least)
    return max(m, n) < LONGEST and all(x - k == 0 or x <= SHORTENED and math.comb(x, k) <= SHORTENED for x in (m, n))


def partners(m: int, least: float) -> list[int]:
    """Lengths of the names that can be similar to one of m letters."""
    r = least / (2 - least)
    return [n for n in range(math.ceil(m * r - 1e-9), math.floor(m / r + 1e-9) + 1) if common_letters(m, n, least) <= min(m, n)]


@functools.cache
def unshortened_from(least: float) -> int:
    """Names of fewer letters are found by shortened forms, whatever the other name's length."""
    return next(m for m in itertools.count() if not all(shortened(m, n, least) for n in partners(m, least)))


@functools.cache
def left_letters(m: int, k: int) -> np.ndarray:
    """Places of all choices of k of m letters."""
    return np.array(list(itertools.combinations(range(m), k)), np.int64).reshape(math.comb(m, k), k)


def shortened_forms(least: float, longer: bool):
    """Batches (name, n) to (key, name, n): for each length of no fewer (longer: no more) letters that a similar name can have, the different subsequences of the normal name that are as long as the common one
    has to be. The key is a hash of both lengths and the letters; n is null where it is the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, n = batch.column(0), batch.column(1)
            own = pc.if_else(pc.equal(name, n), pa.scalar(None, n.type), n)
            size = pc.binary_length(n).to_numpy(zero_copy_only=False)
            for m in np.unique(size).tolist():
                rows = np.flatnonzero(size == m)
                letters = np.frombuffer("".join(n.take(pa.array(rows)).to_pylist()).encode(), np.uint8).reshape(len(rows), m).astype(np.uint64)
                for other in partners(m, least) if m < LONGEST else ():
                    if not shortened(m, other, least) or (other > m if longer else other < m):
                        continue
                    places = left_letters(m, common_letters(m, other, least))
                    step = max(1, FORMS // len(places))
                    for a in range(0, len(rows), step):
                        some = letters[a : a + step]
                        key = np.full((len(some), len(places)), min(m, other) * LONGEST + max(m, other) + 1, np.uint64)
                        for j in range(places.shape[1]):
                            key = (key ^ some[:, places[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        key.sort(axis=1)
                        first = np.ones(key.shape, bool)
                        first[:, 1:] = key[:, 1:] != key[:, :-1]
                        at = pa.array(rows[a : a + step][np.nonzero(first)[0]])
                        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), name.take(at), own.take(at)], ["key", "name", "n"])

    return run


def candidate_names(names: DataFrame, least: float = NAME_THRESHOLD) -> DataFrame:
    """(a, b, na, nb), a < b: pairs of different names (column name) with their normal forms, among them all with at least the similarity ``least``.

    Names of m and n letters are similar if, and only if, they have a subsequence of ``common_letters`` letters in common. Where ``least`` is high, few letters are left
    out, so names are joined on all such subsequences: nearly no other pair meets, however many names there are. Names that have too many of them, and all
    names where ``least`` is low, are joined on rare letters (``by_letters``).
    """
    ready = names.select("name").filter("name IS NOT NULL").distinct().withColumn("n", norm_name(F.col("name")))
    if least < SHORTEN_FROM:
        return by_letters(ready, least)
    forms = lambda longer, x: ready.mapInArrow(shortened_forms(least, longer), f"key long, {x} string, n{x} string").withColumn(f"n{x}", F.coalesce(f"n{x}", x))
    ordered = F.col("a") < F.col("b")
    met = forms(False, "a").join(forms(True, "b"), "key").filter((F.length("na") < F.length("nb")) & (F.col("a") != F.col("b")) | ordered)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(ordered, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(ordered, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    return met.unionByName(by_letters(ready.filter(F.length("n") >= unshortened_from(least)), least)).distinct()


def by_letters(ready: DataFrame, least: float) -> DataFrame:
    """``candidate_names`` of different names with their normal forms (name, n).

    A common subsequence is no longer than the letters that two names share, the k-th a of one counted as the k-th a of the other. With
    2 LCS >= least (m + n), the shorter name has at least r = least / (2 - least) of the longer one's letters, so a name of m letters
    shares at least r m of its own with a similar one. Of these letters, ordered by how few names have them, the first two shared ones
    are then among the first m - r m + 2 of either name: names are joined on pairs of these (on one of the first m - r m + 1 where the lengths
    ask for one shared letter only). The join's condition lets a pair pass once, at the first two letters on which they meet, and only if the
    lengths and the letters that both have allow the similarity; no other pair is built.
    """
    r = least / (2 - least)
    letters = F.transform(characters(F.col("n")), lambda ch, i: F.concat(ch, F.size(F.filter(characters(F.substring(F.col("n"), F.lit(1), i + 1)), lambda x: x == ch)).cast("string")))
    ready = ready.withColumn("letters", letters).withColumns(letter_maps(F.col("letters")))
    keyed = ready.withColumn("letter", F.explode_outer("letters")).drop("letters")
    often = keyed.groupBy("letter").agg(F.count(F.lit(1)).alias("names"))  # as many rows as there are letters and repeats
    ranked = keyed.join(F.broadcast(often), "letter", "left").groupBy("name", "n", *MAPS, "extra").agg(F.sort_array(F.collect_list(F.struct("names", "letter"))).alias("xs"))
    size = F.length("n")
    spare = size - F.ceil(size * r - 1e-9).cast("int")
    heads = F.filter(F.transform(F.slice("xs", F.lit(1), F.greatest(F.lit(1), spare + 2)), lambda x: x["letter"]), lambda x: x.isNotNull())
    two = F.flatten(F.transform("heads", lambda x, i: F.transform(F.slice("heads", i + 2, F.size("heads")), lambda y: F.concat(x, F.lit("-"), y))))
    one = F.when(size <= 2 / least, F.when(size == 0, F.array(F.lit(""))).otherwise(F.slice("heads", F.lit(1), spare + 1))).otherwise(F.array().cast("array<string>"))
    head = ranked.withColumn("heads", heads).drop("xs").withColumn("key", F.explode(F.concat(one, two)))
    a, b = (head.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("heads").alias(f"heads_{x}"), F.col("extra").alias(f"extra_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in MAPS], "key") for x in ("a", "b"))
    la, lb = F.length("na"), F.length("nb")
    shared = F.least("extra_a", "extra_b")
    for m in MAPS:
        shared = shared + F.bit_count(F.col(f"{m}_a").bitwiseAND(F.col(f"{m}_b")))
    near = (F.col("a") < F.col("b")) & (la >= lb * r - 1e-9) & (lb >= la * r - 1e-9) & (2 * shared >= (la + lb) * least - 1e-9)
    met = F.array_intersect("heads_a", "heads_b")
    few = la + lb <= 2 / least  # one shared letter may do
    once = F.col("key") == F.when(few, F.coalesce(F.get(met, F.lit(0)), F.lit(""))).otherwise(F.concat_ws("-", F.get(met, F.lit(0)), F.get(met, F.lit(1))))
    return a.join(b, "key").filter(near & once).select("a", "b", "na", "nb")


def similar_names(names: DataFrame, least: float = NAME_THRESHOLD) -> DataFrame:
    """(a, b, sim), a < b: all pairs of different names (column name) with at least the similarity ``least``."""
    return candidate_names(names, least).select("a", "b", pair_similarity("na", "nb").alias("sim")).filter(F.col("sim") >= least)
