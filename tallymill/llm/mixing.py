"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Documents are cut into blocks of at most BLOCK words. A hash puts each source's blocks into one random order; running sums of words along it,
   computed in stretches, say exactly how far the source's target reaches: all blocks for each whole pass over the source, then the first blocks of
   the order, the last of them cut. So every source gives its target to the word, and no block goes more often than ``most`` times.
2. The blocks that each source gives are its quota. A binary tree over the output shards splits the vector of quotas: a node with an
   even number of shards below gives half its blocks to either side, and how many of each source go left is one multivariate-hypergeometric
   draw, source by source, by inverting the distribution function. The leaves are exact quotas whose sums are the sources' quotas.
3. Shard after shard takes as many blocks of a source's order as its quota says: disjoint stretches of a random order. In each shard the
   blocks are shuffled by another hash.

Shares: sources in code point order, null last, weigh WEIGHTS, repeating. A source stops at ``most`` times its size and the excess is
shared again by weight. As sources stop in the order of size over weight, running sums in that order give the result of all rounds at once.

The driver gets the number of sources, of words and one level. A source that holds any share of all rows is split like any other.

Defined results: a null text has size 0; a document of size 0 gives nothing and has a row; a null source is a source, after all others; the
empty source name is another; rows that repeat a doc_id are documents of their own (those with equal order keys may swap places);
a null doc_id is hashed as the empty text; an empty table gives no rows; texts of any length are counted whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_rank, with_running
from .common import materialize, table, tidy

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
#: Words of a block, words that a shard is planned for, and the most shards.
BLOCK, SHARD_WORDS, MOST_SHARDS = 512, 1 << 20, 4096
#: Sources beside which their table is broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000
#: Standard deviations around the mode that a hypergeometric draw looks at (what lies outside has a probability under 1e-15).
REACH = 8
#: Levels of the tree that one task walks before its nodes are dealt out again.
SPREAD = 4


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"))


def beside(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Each row with the columns of its source."""
    other = sources.withColumnRenamed("source", "__source")
    other = F.broadcast(other) if n_sources <= FEW_SOURCES else other.hint("merge")
    return rows.join(other, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """place, source, source_size, target: what each source is to give. sizes: source, source_size."""
    placed = with_rank(sizes, (), [F.asc_nulls_last("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    limit = F.col("source_size") * most
    # sources stop in the order of limit over weight; share: of one unit of weight, once those before have stopped
    order = [F.col("limit") / F.col("weight"), F.col("place")]
    summed = with_running(placed.withColumns({"weight": weight, "limit": limit}), (), order, {"limits": F.col("limit"), "weights": F.col("weight")})
    whole = summed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = (F.col("all_size") - (F.col("limits") - F.col("limit"))) / (F.col("all_weight") - (F.col("weights") - F.col("weight"))).cast("double")
    shared = summed.crossJoin(F.broadcast(whole)).withColumn("share", share)  # one row
    level = shared.filter(F.col("share") * F.col("weight") <= F.col("limit")).agg(F.min_by("share", F.struct(*order)).alias("level")).first()["level"]
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level).cast("double"))
    return shared.select("place", "source", "source_size", target.alias("target"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """A draw of how many of ``n`` from ``good`` + ``bad`` are good, by inverting the distribution function at the uniform number ``u``."""

    def around(x: Column) -> Column:
        """Adds the mode, and the first and last number that are looked at."""
        g, b, n = x["g"], x["b"], x["n"]
        low, high = F.greatest(F.lit(0.0), n - b), F.least(g, n)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (g + 1) / (g + b + 2)).cast("double")))
        spread = F.ceil(REACH * F.sqrt(n * (g / (g + b)) * (b / (g + b)) * (g + b - n) / F.greatest(F.lit(1.0), g + b - 1))).cast("double") + REACH
        return F.struct(*[x[c].alias(c) for c in ("g", "b", "n", "u")], mode.alias("mode"), F.greatest(low, mode - spread).alias("first"), F.least(high, mode + spread).alias("last"))

    def up(x: Column, k: Column) -> Column:
        """P(k + 1) / P(k)"""
        return (x["g"] - k) * (x["n"] - k) / ((k + 1) * (x["b"] - x["n"] + k + 1))

    walk = lambda a, z: F.when(a <= z, F.sequence(a.cast("long"), z.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    state = lambda p, s: F.struct(p.alias("p"), s.alias("s"))

    def sums(x: Column) -> Column:
        """With the mode's probability as 1: down to the first number, and the sum of all."""
        start = state(F.lit(1.0), F.lit(0.0))
        down = F.aggregate(walk(x["first"], x["mode"] - 1), start, lambda a, k: bound(a["p"] / up(x, x["first"] + x["mode"] - 1 - k), lambda p: state(p, a["s"] + p)))
        above = F.aggregate(walk(x["mode"], x["last"] - 1), start, lambda a, k: bound(a["p"] * up(x, k), lambda p: state(p, a["s"] + p)))
        return bound(F.struct(x.alias("x"), down.alias("down"), above.alias("above")), reached)

    def reached(y: Column) -> Column:
        """From the first number up to where the sum passes its share u."""
        x, p, aim = y["x"], y["down"]["p"], y["x"]["u"] * (y["down"]["s"] + 1 + y["above"]["s"])
        start = F.struct(p.alias("p"), p.alias("s"), x["first"].alias("k"), aim.alias("aim"))
        further = lambda a, k: bound(a["p"] * up(x, k), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s"), (a["k"] + 1).alias("k"), a["aim"].alias("aim")))
        return F.aggregate(walk(x["first"], x["last"] - 1), start, lambda a, k: F.when(a["s"] > a["aim"], a).otherwise(further(a, k)))["k"].cast("long")

    x = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), n.cast("double").alias("n"), u.alias("u"))
    return F.when((n <= 0) | (good <= 0), 0).when(bad <= 0, n).otherwise(bound(bound(x, around), sums)).cast("long")


def left_half(quotas: Column, key: Column, seed: int) -> Column:
    """Multivariate-hypergeometric draw of half of the blocks in ``quotas``: source after source, each from what is left."""
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(whole.alias("left"), F.floor(whole / 2).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def take(a: Column, x: Column) -> Column:
        q, u = x["q"], F.pmod(F.xxhash64(F.lit(seed), key, x["i"]), F.lit(1 << 52)) / float(1 << 52)
        k = hypergeometric(q, a["left"] - q, a["n"], u)
        return bound(k, lambda k: F.struct((a["left"] - q).alias("left"), (a["n"] - k).alias("n"), F.concat(a["out"], F.array(k)).alias("out")))

    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    return F.aggregate(numbered, start, take, lambda a: a["out"])


def split_quotas(sources: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(shard, place, quota): the sources' quotas (place, quota) split over 2**levels shards."""
    pairs = F.sort_array(F.collect_list(F.struct("place", "quota")))
    nodes = sources.agg(pairs.alias("xs")).select(F.lit(0).cast("long").alias("node"), F.transform("xs", lambda x: x["place"]).alias("places"), F.transform("xs", lambda x: x["quota"]).alias("quotas"))
    child = lambda bit, q: F.struct((F.col("node") * 2 + bit).alias("node"), F.col("places"), q.alias("quotas"))
    halves = lambda left: F.array(child(0, left), child(1, F.zip_with("quotas", left, lambda q, k: q - k)))
    for level in range(levels):
        if level and level % SPREAD == 0:  # so far in the tasks of the nodes above
            nodes = nodes.repartition(1 << level, "node")
        key = F.struct(F.lit(level), F.col("node"))
        nodes = nodes.select(F.inline(bound(left_half(F.col("quotas"), key, seed), halves)))
    return nodes.select(F.col("node").alias("shard"), F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("quotas").alias("quota")))).filter("quota > 0")


def blocks(documents: DataFrame, block: int, seed: int) -> DataFrame:
    """row, doc_id, source, block, words, key: the documents (row, doc_id, source, size) in blocks, and their random order."""
    cut = documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
    words = F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)
    key = F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("block").cast("string")).cast("binary")))
    return cut.select("row", "doc_id", "source", "block", words.alias("words"), key.alias("key"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, source, size; sources: place, source, source_size, target)."""
    documents = materialize(sized(docs), "sized")
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    return documents, materialize(targets(sizes, weights, most), "sources")


def draws(documents: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """row, doc_id, source, place, epoch, start, words, draw: every taking of a block, numbered along its source's order, pass after pass."""
    ordered = with_running(blocks(documents, block, seed), ("source",), [F.col("key"), F.col("row")], {"at": F.lit(1), "upto": F.col("words")})
    n_blocks = ordered.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    known = sources.filter("source_size > 0").select("place", "source", "source_size", goal.alias("goal"))
    n_sources = known.count()
    known = beside(known, n_blocks, n_sources)
    passes = F.floor(F.col("goal") / F.col("source_size"))
    known = known.select("place", "source", "n_blocks", passes.alias("passes"), (F.col("goal") - passes * F.col("source_size")).alias("rest"))
    taken = F.when(F.col("epoch") < F.col("passes"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - (F.col("upto") - F.col("words"))))
    rows = beside(ordered, known, n_sources).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    rows = rows.withColumn("taken", taken).filter("taken > 0")
    return rows.select("row", "doc_id", "source", "place", "epoch", (F.col("block") * block).alias("start"), F.col("taken").alias("words"), (F.col("epoch") * F.col("n_blocks") + F.col("at") - 1).alias("draw"))


def deal(drawn: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``drawn`` with shard and position: stretches of each source's draws by the tree's quotas, shuffled in each shard."""
    quotas = materialize(drawn.groupBy("place").agg(F.count(F.lit(1)).alias("quota"), F.sum("words").alias("words")), "quotas")
    total = quotas.agg(F.sum("words")).first()[0] or 0
    levels = min(max(0, math.ceil(math.log2(max(1, total / shard_words)))), MOST_SHARDS.bit_length() - 1)
    shards = materialize(split_quotas(quotas, levels, seed), "shards")
    # a source's stretches, met by cells about as long: a cell holds a shard's worth of its draws, a stretch lies in few cells
    upto = F.sum("quota").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = quotas.select("place", F.ceil(F.col("quota") / float(1 << levels)).cast("long").alias("cell_size"))
    few = quotas.count() <= FEW_SOURCES
    with_cell = lambda df: df.join(F.broadcast(cells) if few else cells.hint("merge"), "place")
    stretch = with_cell(shards.select("shard", "place", (upto - F.col("quota")).alias("low"), upto.alias("high")))
    stretch = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / F.col("cell_size")), F.floor((F.col("high") - 1) / F.col("cell_size")))))
    placed = with_cell(drawn).withColumn("cell", F.floor(F.col("draw") / F.col("cell_size")))
    inside = (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))
    dealt = placed.join(stretch.select("shard", "place", "cell", "low", "high"), ["place", "cell"]).filter(inside)
    mixed = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "place", "draw"), "place", "draw")
    return dealt.select("shard", (F.row_number().over(mixed) - 1).cast("long").alias("position"), *drawn.columns)


@tidy("mix")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """shard, position, doc_id, source, epoch, start, words (and row, place, draw): the mix, block by block."""
    return deal(materialize(draws(*plan(docs, weights, most), block, seed), "draws"), shard_words, seed)


@tidy("mixed-counts")
def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the words of its blocks in the mix."""
    documents, sources = plan(docs, weights, most)
    dealt = deal(materialize(draws(documents, sources, block, seed), "draws"), shard_words, seed)
    taken = dealt.groupBy(F.col("row").alias("__row")).agg(F.sum("words").alias("taken"))
    whole = documents.join(taken.hint("merge"), F.col("row") == F.col("__row"), "left")
    known = beside(whole, sources.select("source", "source_size", "target"), sources.count())
    return known.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, sum(3 * z) OVER o - 3 * z AS stopped, sum(w) OVER o - w AS stopped_w, sum(z) OVER () AS all_z, sum(w) OVER () AS all_w FROM w WINDOW o AS (ORDER BY 3 * z / CAST(w AS DOUBLE), place)),
h AS (SELECT *, CAST(all_z - stopped AS DOUBLE) / CAST(all_w - stopped_w AS DOUBLE) AS share FROM c),
t AS (SELECT place, source, z, least(CAST(3 * z AS DOUBLE), w * (SELECT arg_min(share, (3 * z / CAST(w AS DOUBLE), place)) FROM h WHERE share * w <= 3 * z)) AS target FROM h),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
b AS (SELECT r, doc_id, source, size, unnest(generate_series(0, (size - 1) // {BLOCK})) AS block FROM d WHERE size > 0),
k AS (SELECT *, least({BLOCK}, size - block * {BLOCK}) AS words, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', block)) AS key FROM b),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, r ROWS UNBOUNDED PRECEDING) - words AS before FROM k),
x AS (SELECT u.r, sum(goal // z * words + greatest(0, least(words, goal % z - before))) AS taken FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source GROUP BY u.r)
SELECT d.doc_id, d.size, g.z AS source_size, g.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON x.r = d.r
"""
