"""Ratios and percentiles with the engine's empty-case rules."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the values of a group are cut into when their ranks are counted.
PARTS = 1000


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """0 wherever a denominator is 0."""
    p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return p, r, ratio(2 * p * r, p + r, 0.0)


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of rows where the condition holds, of all rows or of those in ``among``; null if there are none."""
    value = F.when(condition, 1.0).otherwise(0.0)
    return F.avg(value if among is None else F.when(among, value))


def pct(c: Column, q: float) -> Column:
    """Exact percentile with linear interpolation; nulls and NaN do not count, null if nothing is left."""
    return F.percentile(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(q))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def percentiles(rows: DataFrame, by: tuple[str, ...], measures: dict[str, Column], points: dict[str, float]) -> DataFrame:
    """by and {measure}_{point}: exact percentiles with linear interpolation of every measure, null where a group has no value.

    ``pct`` holds all different values of a group in one task. Here the values of each group and measure are counted first, then cut
    at approximate percentiles into about PARTS parts; the parts' sizes give the ranks, and only the parts that hold a wanted rank
    are ordered. The approximation decides how even the parts are, never the result.
    """
    value = [F.struct(F.lit(m).alias("measure"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("v")) for m, c in measures.items()]
    long = rows.select(*by, F.explode(F.array(*value)).alias("x")).select(*by, "x.measure", "x.v").filter("v IS NOT NULL")
    key = [*by, "measure"]
    counted = long.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = long.groupBy(*key).agg(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 2 * PARTS).alias("cuts"), F.count(F.lit(1)).alias("total"))
    # the part of a value: how many cuts lie under it, found by bisection
    part = F.aggregate(
        F.sequence(F.lit(1), F.lit(PARTS.bit_length() + 1)),
        F.struct(F.lit(0).alias("lo"), F.size("cuts").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.get("cuts", F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("v"), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        ),
    )["lo"]
    dealt = beside(counted, cuts, key).withColumn("part", part).drop("cuts")
    sizes = dealt.groupBy(*key, "part", "total").agg(F.sum("n").alias("size"))
    below = F.sum("size").over(Window.partitionBy(*key).orderBy("part")) - F.col("size")
    wanted = F.array(*[F.struct(F.lit(p).alias("point"), (F.lit(q) * (F.col("total") - 1)).alias("place")) for p, q in points.items()])
    ranks = F.filter(wanted, lambda w: (F.floor(w["place"]) < F.col("below") + F.col("size")) & (F.ceil(w["place"]) >= F.col("below")))
    parts = sizes.withColumn("below", below).withColumn("wanted", ranks).filter(F.size("wanted") > 0).select(*key, "part", "below", "wanted")
    held = beside(dealt, parts, [*key, "part"])
    end = F.col("below") + F.sum("n").over(Window.partitionBy(*key, "part").orderBy("v"))
    found = held.withColumn("end", end).select(*key, "v", (F.col("end") - F.col("n")).alias("start"), "end", F.explode("wanted").alias("w"))
    low, high = F.floor("w.place"), F.ceil("w.place")
    inside = lambda r: (F.col("start") <= r) & (r < F.col("end"))
    ends = found.groupBy(*key, "w").agg(F.max(F.when(inside(low), F.col("v"))).alias("a"), F.max(F.when(inside(high), F.col("v"))).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("w.place") - F.floor("w.place"))
    wide = ends.groupBy(*by).agg(*[F.max(F.when((F.col("measure") == m) & (F.col("w.point") == p), value_at)).alias(f"{m}_{p}") for m in measures for p in points])
    return beside(rows.select(*by).distinct(), wide, by, "left") if by else wide
