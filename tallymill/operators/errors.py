"""Attribution of wrong fields and unmatched items to causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amount_present, money_equal, number_strings, parse_amount
from ..functions.names import name_in_lines, norm_name, norm_names
from ..functions.text import digits
from ..store import keep
from ..types import SCORED_FIELDS
from .match import PRICE_TOL

BUCKETS = ("ocr", "missed", "wrong_value", "spurious", "normalisation", "item_ocr", "item_missed", "item_price_only", "item_extra")


def scalar_errors(df: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, field, bucket, gold, pred) of wrong scalar fields. df: keys, pred, gold, raw_pred and raw_gold (maps of printed forms), lines."""
    none = F.array().cast("array<string>")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col("pred")[f].alias("pv"), F.col("gold")[f].alias("gv")) for f in SCORED_FIELDS])
    wrong = F.filter(fields, lambda x: ~money_equal(x["pv"], x["gv"], PRICE_TOL))
    # right records are dropped before their lines are searched for numbers, and before anything is printed: Spark moves the filter below both
    rows = df.withColumn("wrong", wrong).filter(F.size("wrong") > 0).select(*keys, number_strings(F.coalesce("lines", none)).alias("numbers"), "raw_pred", "raw_gold", "wrong")
    rows = rows.select(*keys, "numbers", "raw_pred", "raw_gold", F.inline("wrong"))
    rows = rows.withColumns({"praw": F.try_element_at("raw_pred", F.col("field")), "graw": F.try_element_at("raw_gold", F.col("field"))})
    same_print = (digits(F.col("praw")) != "") & (digits(F.col("praw")) == digits(F.col("graw")))
    bucket = (
        F.when(F.col("gv").isNull(), "spurious")
        .when(F.col("praw").isNotNull() & same_print & ~money_equal(parse_amount(F.col("praw")), F.col("gv"), PRICE_TOL), "normalisation")
        .when(~amount_present(F.col("gv"), F.col("graw"), F.col("numbers")), "ocr")
        .when(F.col("pv").isNull(), "missed")
        .otherwise("wrong_value")
    )
    return rows.select(*keys, "field", bucket.alias("bucket"), F.col("gv").alias("gold"), F.col("pv").alias("pred"))


def item_errors(df: DataFrame, check_names: bool = True, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, side, item, bucket, name, line_total) of unmatched items. df: keys, pred, gold, pairs, name_pairs, lines."""
    no_pairs = F.array().cast("array<struct<side:string,item:int,partner:int,name:string,line_total:double>>")
    matched = lambda side, k, pairs="pairs": F.exists(pairs, lambda x: x[side] == k)
    partner = lambda j: F.try_element_at(F.filter("name_pairs", lambda x: x["j"] == j), F.lit(1))["i"]
    shape = lambda side, k, x, p: F.struct(F.lit(side).alias("side"), k.cast("int").alias("item"), p.cast("int").alias("partner"), x["name"].alias("name"), x["line_total"].alias("line_total"))
    # both sides' unmatched items in one list, so that a record is matched once, and its lines are read once, if it has any. No filter on the list and no
    # inner inline, from which Spark infers one: it would move below the matching, and match all records again
    used = F.transform(F.filter("name_pairs", lambda x: ~matched("j", x["j"])), lambda x: x["i"])
    missing = F.transform(F.col("gold")["items"], lambda x, j: F.when(~matched("j", j), shape("gold", j, x, partner(j))))
    extra = F.transform(F.col("pred")["items"], lambda x, i: F.when(~matched("i", i) & ~F.array_contains("used", i), shape("pred", i, x, F.lit(None))))
    df = df.select(*keys, "pairs", "name_pairs", "lines", "gold", "pred", used.alias("used"))
    df = df.select(*keys, "pairs", "lines", F.array_compact(F.concat(F.coalesce(missing, no_pairs), F.coalesce(extra, no_pairs))).alias("open"))
    df = df.withColumn("lines", F.when(F.size("open") > 0, F.coalesce("lines", F.array().cast("array<string>"))))
    rows = df.select(*keys, "pairs", "lines", F.when(F.size("open") > 0, number_strings(F.col("lines"))).alias("numbers"), F.inline_outer("open")).filter("side IS NOT NULL")
    price_only = F.col("partner").isNotNull() & ~matched("i", F.col("partner"))
    printed = amount_present(F.col("line_total"), F.lit(None).cast("string"), F.col("numbers"))
    bucket = F.when(F.col("side") == "pred", "item_extra").when(~printed, "item_ocr").when(price_only, "item_price_only")
    rows = rows.select(*keys, "side", "item", "name", "line_total", "lines", bucket.alias("decided"))
    # names are looked up in Python, and only where nothing else decides: other rows bring no lines
    if check_names:
        open_ = F.col("decided").isNull()
        rows = rows.withColumn("seen", name_in_lines(F.when(open_, norm_name(F.col("name"))), F.when(open_, norm_names(F.col("lines")))))
    last = F.when(F.col("seen"), "item_missed").otherwise("item_ocr") if check_names else F.lit("item_missed")
    return rows.select(*keys, "side", "item", F.coalesce("decided", last).alias("bucket"), "name", "line_total")


def bucket_report(errors: DataFrame, example: Column, most: int = 6) -> DataFrame:
    """One row for each bucket in the fixed order, zero counts included, with the first examples by value. The errors are found once: buckets and examples
    are written to the shared folder, from where both counts and examples are read."""
    spark = errors.sparkSession
    order = spark.createDataFrame([(b, i) for i, b in enumerate(BUCKETS)], "bucket string, place int")
    found = keep(errors.select("bucket", example.alias("example")), "errors")
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("example"))).filter(F.col("k") <= most)
    examples = first.groupBy("bucket").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    none = F.array().cast("array<string>")
    joined = order.join(counts, "bucket", "left").join(examples, "bucket", "left")
    return joined.select("place", "bucket", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("examples", none).alias("examples"))
