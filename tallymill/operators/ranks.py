"""Ranks and running sums over groups of any size, without a task that holds a whole group.

Rows are dealt by ranges of (group, order), so each task holds a stretch of the total order, and written down. Each stretch
of a group is summed, a small join adds to every row what the stretches before its own hold, and only the sums inside a stretch are
computed by a window. Stretches of groups that lie in one task need no offset; of the others there are at most two for each
task, and only these rows reach the driver.

Defined results: nulls come first in ascending and last in descending order; a null group is a group; rows equal in group and
order are put in one order or another, each in a place of its own, so callers who need the same ranks again give an order
without ties; nulls count 0 in sums, which must be whole numbers (their sums do not depend on the order of addition); an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep

PART, OFFSET = "__part", "__before_"


def _in_parts(df: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """``df`` by ranges of (by, order) with the number of its stretch and its place there, on disk."""
    # a constant number: adaptive execution must not merge stretches by size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # stretch << 33 | row of the stretch, in its order
    return keep(dealt.withColumn(PART, place), "ranges").withColumns({PART: F.shiftright(PART, 33).cast("int"), "__row": F.col(PART).bitwiseAND(F.lit((1 << 33) - 1))})


def _offsets(parted: DataFrame, by: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """(by, part) with what the stretches of the group before this one hold; only of groups with several stretches."""
    spark, names = parted.sparkSession, list(sums)
    stretches = parted.groupBy(*by, PART).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    if by:
        spans = stretches.groupBy(*by).agg(F.collect_list(F.struct(PART, *names)).alias("xs")).filter(F.size("xs") > 1)
        found = spans.select(*by, F.inline("xs")).collect()
    else:
        found = stretches.collect()
    before: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(names))
    rows = []
    for r in sorted(found, key=lambda r: r[PART]):
        group = tuple(r[c] for c in by)
        rows.append((*group, r[PART], *before[group]))
        before[group] = [a + r[n] for a, n in zip(before[group], names, strict=True)]
    fields = ", ".join([*(f"`{c}` {parted.schema[c].dataType.simpleString()}" for c in by), f"{PART} int", *(f"{OFFSET}{n} long" for n in names)])
    return spark.createDataFrame(rows, fields)


def _beside(parted: DataFrame, offsets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each row with its stretch's offsets (at most two rows for each task: a bounded broadcast), 0 where there is none."""
    other = offsets.withColumnsRenamed({c: f"__of_{c}" for c in (*by, PART)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, PART)])
    joined = parted.join(F.broadcast(other), same, "left").drop(*[f"__of_{c}" for c in (*by, PART)])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in offsets.columns if c.startswith(OFFSET)})


def with_rank(df: DataFrame, by: tuple[str, ...], order: list[Column], rank: str = "rank") -> DataFrame:
    """Adds the place of each row in its group, from 1. One shuffle of the rows."""
    parted = _in_parts(df, by, order)
    # the first row of a group's stretch is its least place: its rank is 1 + offset + (place - least place)
    first = parted.groupBy(*by, PART).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n")) if by else None
    offsets = _offsets(parted, by, {rank: F.lit(1)})
    rows = _beside(parted, offsets, by)
    if first is None:
        start = F.lit(0)
    else:
        # groups that begin inside a stretch: as many rows as groups, joined on their own keys
        key = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, PART)]
        begun = first.drop("n").withColumnsRenamed({c: f"__of_{c}" for c in (*by, PART)})
        rows = rows.join(begun, reduce(lambda a, b: a & b, key)).drop(*[f"__of_{c}" for c in (*by, PART)])
        start = F.col("__first")
    return rows.withColumn(rank, F.col(f"{OFFSET}{rank}") + F.col("__row") - start + 1).select(*df.columns, rank)


def with_running(df: DataFrame, by: tuple[str, ...], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds under each name of ``sums`` the sum of its whole-number column over the rows of the group up to and with this one."""
    parted = _in_parts(df, by, order)
    rows = _beside(parted, _offsets(parted, by, sums), by)
    inside = Window.partitionBy(*by, PART).orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("long") + F.col(f"{OFFSET}{n}") for n, c in sums.items()}
    return rows.withColumns(found).select(*df.columns, *sums)
