"""Records derived from the order tables, so that every operator can run, and be checked, on whole tables.

All money is computed in whole cents and divided by 100 at the end. A record's gold form comes from an order's lines;
two systems' predictions are the gold form with one fixed change, chosen by the order key:

0 none; 1 total 5 too high; 2 no tax; 3 first item missing; 4 item names reversed; 5 no subtotal; 6 no output;
7 no total; 8 an extra item; 9 first line total doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_table
from ..types import ITEM, RECEIPT

SYSTEMS = {"rules": 0, "model": 3}


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def money(c: Column) -> Column:
    return c.cast("double") / 100.0


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, name, qty, cents, unit_cents of every order line."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("cents", cents(F.col("l_extendedprice")))
    return rows.select(
        F.col("l_orderkey").alias("k"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "cents", "l_quantity").alias("place"),
        F.col("p_name").alias("name"),
        F.col("l_quantity").alias("qty"),
        "cents",
        F.floor(F.col("cents") / F.col("l_quantity") + 0.5).cast("long").alias("unit_cents"),
    )


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (order key), gold, and the amounts in cents; one shuffle, on the order key."""
    item = F.struct(F.col("name"), F.col("qty").alias("quantity"), money(F.col("unit_cents")).alias("unit_price"), money(F.col("cents")).alias("line_total")).cast(ITEM)
    orders = lines_of(spark, sf_dir).groupBy("k").agg(F.sum("cents").alias("sub"), F.sort_array(F.collect_list(F.struct("place", item.alias("item")))).alias("xs"))
    k = F.col("k")
    orders = orders.withColumns(
        {
            "disc": F.when(k % 3 == 0, F.expr("sub div 20")),
            "svc": F.when(k % 4 == 0, F.expr("sub div 20")),
            "tax": F.when(k % 5 != 0, F.expr("sub div 10")),
        }
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    orders = orders.withColumn("total", F.col("sub") - zero("disc") + zero("svc") + zero("tax"))
    gold = F.struct(
        F.concat(F.lit("store "), (k % 50).cast("string")).alias("store_name"),
        F.transform("xs", lambda x: x["item"]).alias("items"),
        money(F.col("sub")).alias("subtotal"),
        money(F.col("disc")).alias("discount"),
        money(F.col("tax")).alias("tax"),
        money(F.col("svc")).alias("service_charge"),
        money(F.col("total")).alias("total"),
        F.when(k % 2 == 0, "IDR").alias("currency"),
    ).cast(RECEIPT)
    return orders.select(k.alias("id"), gold.alias("gold"), "sub", "disc", "svc", "tax", "total")


def change(gold: Column, m: Column) -> Column:
    """The predicted record of change ``m``."""
    items = gold["items"]
    none = F.lit(None).cast("double")
    double_first = F.transform(items, lambda x, i: F.when(i == 0, x.withField("line_total", x["line_total"] * 2)).otherwise(x))
    extra = F.concat(items, F.array(F.struct(F.lit("free sample").alias("name"), F.lit(1.0).alias("quantity"), F.lit(0.5).alias("unit_price"), F.lit(0.5).alias("line_total")).cast(ITEM)))
    new_items = (
        F.when(m == 3, F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))))
        .when(m == 4, F.transform(items, lambda x: x.withField("name", F.reverse(x["name"]))))
        .when(m == 8, extra)
        .when(m == 9, double_first)
        .otherwise(items)
    )
    out = (
        gold.withField("items", new_items)
        .withField("total", F.when(m == 1, gold["total"] + 5).when(m == 7, none).otherwise(gold["total"]))
        .withField("tax", F.when(m == 2, none).otherwise(gold["tax"]))
        .withField("subtotal", F.when(m == 5, none).otherwise(gold["subtotal"]))
    )
    return F.when(m != 6, out)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, id, m, pred, error, gold and the gold cents."""
    rows = gold_records(spark, sf_dir).withColumn("system", F.explode(F.array(*map(F.lit, SYSTEMS))))
    shift = F.coalesce(*[F.when(F.col("system") == s, F.lit(o)) for s, o in SYSTEMS.items()])
    rows = rows.withColumn("m", ((F.col("id") + shift) % 10).cast("int"))
    return rows.withColumns({"pred": change(F.col("gold"), F.col("m")), "error": F.when(F.col("m") == 6, "json: malformed")})


def grouped(c: Column) -> Column:
    """1,234.56 of cents."""
    return F.concat(F.format_number(F.expr("0") + F.floor(c / 100), 0), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def printed_lines(rows: DataFrame) -> DataFrame:
    """Adds ``lines``: the record as printed. Every 13th record prints no total."""
    g = F.col("gold")
    item = lambda x: F.concat(x["quantity"].cast("int").cast("string"), F.lit(" x "), F.upper(x["name"]), F.lit(" "), grouped(F.round(x["line_total"] * 100).cast("long")))
    one = lambda label, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(label), grouped(F.col(c))))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.upper(g["store_name"]))
    total = F.when(F.col("id") % 13 != 0, F.array(F.concat(F.lit("GRAND TOTAL Rp "), grouped(F.col("total"))))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("lines", F.concat(head, F.transform(g["items"], item), one("Sub Total ", "sub"), one("Disc ", "disc"), one("Service ", "svc"), one("Tax ", "tax"), total))
