"""Typed records from polymorphic JSON: labelled trees and model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import detect_currency, parse_amount, parse_quantity
from ..functions.text import blank_to_null, first_of, let, strip
from ..types import ITEM, MONEY_FIELDS, RECEIPT


def kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING, BIGINT, ... of a variant; null for null and JSON null."""
    k = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    return F.when(k != "VOID", k)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def elements(v: Column) -> Column:
    """Members of an array; a single value is an array of one; null gives an empty array."""
    none = F.array().cast("array<variant>")
    return F.when(v.isNull(), none).when(kind(v) == "ARRAY", F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).otherwise(F.array(v))


def text_of(v: Column) -> Column:
    """A scalar as text; arrays and objects give null."""
    return F.when(~kind(v).isin("ARRAY", "OBJECT"), F.try_variant_get(v, "$", "string"))


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "TINYINT", "SMALLINT")


def scalar_amount(v: Column) -> Column:
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    return let(kind(v), lambda k: F.when(k.isin(*NUMBERS), number).when(k == "STRING", parse_amount(text)))


def amount_of(v: Column) -> Column:
    """Without sign; of a list the first member that parses."""
    return F.abs(first_of(F.filter(F.transform(let(v, elements), scalar_amount), lambda x: x.isNotNull())))


def first_member(v: Column) -> Column:
    """The first element of an array, else the value itself; an empty array gives null."""
    return let(v, lambda x: F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$[0]", "variant")).otherwise(x))


def quantity_of(v: Column) -> Column:
    """Numbers keep their sign; of a list only the first element counts."""

    def of_scalar(one: Column) -> Column:
        number, text = F.try_variant_get(one, "$", "double"), F.try_variant_get(one, "$", "string")
        return let(kind(one), lambda k: F.when(k.isin(*NUMBERS), number).when(k == "STRING", parse_quantity(text)))

    return let(let(v, first_member), of_scalar)


def objects(v: Column) -> Column:
    return F.filter(elements(v), lambda x: kind(x) == "OBJECT")


def record(items: Column, money: dict[str, Column], store: Column, currency: Column) -> Column:
    fields = [blank_to_null(store).alias("store_name"), items.cast(f"array<{ITEM}>").alias("items"), *[money[f].alias(f) for f in MONEY_FIELDS], blank_to_null(currency).alias("currency")]
    return F.struct(*fields).cast(RECEIPT)


def tree_record(tree: Column) -> Column:
    """The record of a labelled tree (menu, sub_total, total). Entries without a name are no items; modifiers do not count."""

    def item(e: Column) -> Column:
        amounts = F.array(*[amount_of(first_member(at(e, f"$.{f}"))) for f in ("price", "itemsubtotal", "unitprice")])
        # what is printed decides, whether or not it parses
        has_whole, has_unit = kind(at(e, "$.itemsubtotal")).isNotNull(), kind(first_member(at(e, "$.unitprice"))).isNotNull()

        def shaped(name: Column, a: Column) -> Column:
            price, whole, unit = (F.get(a, F.lit(k)) for k in range(3))
            return F.struct(
                strip(F.coalesce(text_of(name), F.lit(""))).alias("name"),
                quantity_of(at(e, "$.cnt")).alias("quantity"),
                F.when(has_whole & ~has_unit, price).otherwise(unit).alias("unit_price"),
                F.when(has_whole, whole).otherwise(price).alias("line_total"),
            )

        return let(first_member(at(e, "$.nm")), lambda name: F.when(kind(name).isNotNull(), let(amounts, lambda a: shaped(name, a))))

    items = F.filter(F.transform(objects(at(tree, "$.menu")), item), lambda x: x.isNotNull())
    sub, total = first_member(at(tree, "$.sub_total")), first_member(at(tree, "$.total"))
    money = {
        "subtotal": amount_of(at(sub, "$.subtotal_price")),
        "discount": amount_of(at(sub, "$.discount_price")),
        "tax": amount_of(at(sub, "$.tax_price")),
        "service_charge": amount_of(at(sub, "$.service_price")),
        "total": amount_of(at(total, "$.total_price")),
    }
    none = F.lit(None).cast("string")
    return record(items, money, none, none)


#: Where a labelled tree prints the scored fields.
TREE_FIELDS = {"total": ("total", "total_price"), "subtotal": ("sub_total", "subtotal_price"), "tax": ("sub_total", "tax_price"), "service_charge": ("sub_total", "service_price")}


def printed_fields(tree: Column) -> Column:
    """field -> text of a labelled tree as it is printed; of a list the first element."""
    texts = [text_of(first_member(at(first_member(at(tree, f"$.{block}")), f"$.{key}"))) for block, key in TREE_FIELDS.values()]
    return F.map_from_arrays(F.array(*map(F.lit, TREE_FIELDS)), F.array(*texts))


def object_record(v: Column) -> Column:
    """The record of a flat JSON object with the record's own field names; unknown fields do not count."""

    def item(e: Column) -> Column:
        return F.struct(
            strip(F.coalesce(text_of(at(e, "$.name")), F.lit(""))).alias("name"),
            quantity_of(at(e, "$.quantity")).alias("quantity"),
            amount_of(at(e, "$.unit_price")).alias("unit_price"),
            amount_of(at(e, "$.line_total")).alias("line_total"),
        )

    return record(F.transform(objects(at(v, "$.items")), item), {f: amount_of(at(v, f"$.{f}")) for f in MONEY_FIELDS}, text_of(at(v, "$.store_name")), text_of(at(v, "$.currency")))


def with_tree_record(df: DataFrame, raw: str = "raw", out: str = "gold") -> DataFrame:
    return df.withColumn(out, tree_record(F.try_parse_json(F.col(raw))))


def with_parsed_output(df: DataFrame, raw: str = "raw", out: str = "pred") -> DataFrame:
    """Adds the record of a model's output text, and why there is none."""
    df = df.withColumn("__v", F.try_parse_json(F.col(raw)))
    v = F.col("__v")
    bad_items = at(v, "$.items").isNotNull() & ~kind(at(v, "$.items")).isin("ARRAY", "OBJECT")
    error = F.when(v.isNull(), "json: malformed").when(F.coalesce(kind(v), F.lit("")) != "OBJECT", "json: not an object").when(F.coalesce(bad_items, F.lit(False)), "schema: items")
    df = df.withColumn("error", error)
    return df.withColumn(out, F.when(F.col("error").isNull(), object_record(v))).drop("__v")


def with_currency(df: DataFrame, receipt: str = "pred", lines: str = "lines") -> DataFrame:
    """Where a record names no currency, the one its lines show."""
    shown = detect_currency(F.array_join(lines, "\n"))
    return df.withColumn(receipt, F.when(F.col(receipt).isNotNull(), F.col(receipt).withField("currency", F.coalesce(F.col(receipt)["currency"], shown))))


def prompt(lines: Column, instructions: str) -> Column:
    """Chat messages: the instructions, and the document fenced as data."""
    body = F.concat(F.lit("Document text, one printed line per line:\n<receipt>\n"), F.array_join(lines, "\n"), F.lit("\n</receipt>"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(instructions)), message("user", body))


#: What a model is asked for: every value as printed.
OUTPUT_SCHEMA = "struct<store_name:string,items:array<struct<name:string,quantity:string,unit_price:string,line_total:string>>,subtotal:string,discount:string,tax:string,service_charge:string,total:string,currency:string>"
