"""Joins and set operations that tie runs, gold records and subsets together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import format_money


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``; an aggregate, so hot keys are combined before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(order))).alias("__r"))
    return best.select(key, *[F.col("__r")[c].alias(c) for c in cols]).select(rows.columns)


def usable(preds: DataFrame) -> DataFrame:
    """Predictions that did not end in an exception."""
    return preds.filter(F.coalesce("exception", F.lit("")) == "")


def attach_gold(preds: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Inner join; use ``missing_gold`` to see predictions without a gold record."""
    return preds.join(gold, key)


def missing_gold(preds: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    return preds.join(gold, key, "left_anti")


def attach_lines(preds: DataFrame, ocr: DataFrame, key: str = "id") -> DataFrame:
    """Left join; predictions without lines get an empty list."""
    return preds.join(ocr.select(key, "lines"), key, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def todo(gold: DataFrame, done: DataFrame, key: str = "id", retry_failed: bool = True) -> DataFrame:
    """Gold rows still to do; failed ones are done again unless told otherwise."""
    finished = usable(done) if retry_failed and "exception" in done.columns else done
    return gold.join(finished.select(key), key, "left_anti")


def progress(gold: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """One row (n_done, n_todo): gold keys that have a usable result, and those that do not; results without a gold row do not count."""
    finished = (usable(done) if "exception" in done.columns else done).select(key).distinct().withColumn("__done", F.lit(True))
    rows = gold.select(key).distinct().join(finished, key, "left")
    return rows.agg(F.count("__done").alias("n_done"), F.count_if(F.col("__done").isNull()).alias("n_todo"))


def complete(rows: DataFrame, *names: str) -> DataFrame:
    """Rows without a null (NaN counts as one) in the named columns, or in any."""
    return rows.dropna("any", subset=list(names) or None)


def limit_total(rows: DataFrame, order: str, limit: int, n_done: int = 0) -> DataFrame:
    """What is left of a limit that counts finished rows as well."""
    return rows.orderBy(order).limit(max(0, limit - n_done))


def common_subset(runs: DataFrame, full: int, group: str = "system", key: str = "id") -> DataFrame:
    """Ids that every partial run (fewer than ``full`` ids) covers; no rows if no run is partial."""
    pairs = runs.select(group, key).distinct()
    partial = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < full).select(group)
    wanted = partial.agg(F.count(F.lit(1)).alias("groups"))
    seen = pairs.join(partial, group).groupBy(key).agg(F.count(F.lit(1)).alias("groups"))
    return seen.join(F.broadcast(wanted), "groups").select(key)


def covering(runs: DataFrame, ids: DataFrame, group: str = "system", key: str = "id") -> DataFrame:
    """Runs that cover all ids."""
    total = ids.agg(F.count(F.lit(1)).alias("n"))
    return runs.select(group, key).distinct().join(ids, key).groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), "n").select(group)


def on_subset(runs: DataFrame, full: int, group: str = "system", key: str = "id") -> DataFrame:
    """The runs' rows on the ids that every partial run covers, for the runs that cover them all."""
    ids = common_subset(runs, full, group, key)
    return runs.join(ids, key, "left_semi").join(covering(runs, ids, group, key), group, "left_semi")


def record_items(records: DataFrame, record: str = "receipt", key: str = "id") -> DataFrame:
    """(key, place, name, quantity, unit_price, line_total): a row for each item, amounts as shown."""
    rows = records.select(key, F.posexplode(F.col(record)["items"]).alias("place", "x"))
    return rows.select(key, "place", "x.name", "x.quantity", *[format_money(F.col("x")[c]).alias(c) for c in ("unit_price", "line_total")])


def record_scalars(records: DataFrame, record: str = "receipt", key: str = "id") -> DataFrame:
    """(key, field, value): a row for each scalar field in fixed order, amounts as shown, absent values as a dash."""
    r, money = F.col(record), ("subtotal", "discount", "tax", "service_charge", "total")
    shown = [(f, format_money(r[f]) if f in money else F.coalesce(r[f], F.lit("-"))) for f in ("store_name", *money, "currency")]
    return records.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in shown])))


def manifest(rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, n): rows of each split."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def run_stem(split: Column, system: Column, model: Column, version: Column) -> Column:
    """Name of a prediction file: split__system, and for model runs __model__prompt with the model's signs made safe."""
    safe = F.replace(F.replace(F.coalesce(model, F.lit("")), F.lit(":"), F.lit("-")), F.lit("/"), F.lit("_"))
    return F.when(system == "regex", F.concat_ws("__", split, system)).otherwise(F.concat_ws("__", split, system, safe, version))


def to_long(df: DataFrame, ids: list[str], values: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Wide metrics to (metric, value), with display names."""
    long = df.unpivot(ids, values, "metric", "value")
    if names:
        shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        long = long.withColumn("metric", F.coalesce(F.try_element_at(shown, F.col("metric")), F.col("metric")))
    return long


def split_alias(c: Column) -> Column:
    """dev and test name the splits validation and test; anything else is itself."""
    return F.when(c == "dev", "validation").otherwise(c)


def record_id(split: Column, index: Column) -> Column:
    return F.format_string("%s_%03d", split, index)


def system_label(stem: Column, labels: dict[str, str]) -> Column:
    """Display name of a prediction file stem split__system[__model[__prompt]]; the model's first dash stands for a colon."""
    parts = F.split(stem, "__")
    system, model, version = F.get(parts, F.lit(1)), F.regexp_replace(F.get(parts, F.lit(2)), "^([^-]*)-", "$1:"), F.get(parts, F.lit(3))
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    exact = F.try_element_at(known, F.concat_ws("__", system, F.get(parts, F.lit(2))))
    base = F.coalesce(exact, F.concat(F.coalesce(F.try_element_at(known, system), system), F.lit(" "), model))
    return F.when(version.isNull(), F.coalesce(F.try_element_at(known, system), system)).otherwise(F.concat(base, F.lit(" ["), version, F.lit("]")))


def with_flag(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds whether ``others`` have the row's key; a null key has none. One join, with as many rows of ``others`` as they have keys."""
    there = others.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
