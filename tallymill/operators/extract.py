"""Rule-based extraction of a record from its text lines: each line is read in Arrow batches, records are folded by array expressions."""

from __future__ import annotations

import functools
import operator
import re
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.amounts import FIND_AMOUNTS, relisted, tokens_in, values_of
from ..functions.names import flat
from ..types import RECEIPT

# Label patterns of printed lines.
SUBTOTAL = r"(?i)\b(sub\s*-?\s*t\w{0,3}l\b|net\s*amt|total\s*item\s*price)"
TAX = r"(?i)\b(tax|pb\s*1|ppn|vat|pajak)\b"
SERVICE = r"(?i)\b(service|svc|s\.?c\.?\b|serv\.?\s*charge)"
DISCOUNT = r"(?i)\b(disc|discount|potongan)"
GRAND = r"(?i)\bgrand\s*total"
TOTAL = r"(?i)((?<![a-z])t?otal\b|\bjumlah\b|\bamount\s*due\b)"
NOT_TOTAL = r"(?i)(sub\s*-?\s*total|total\s*(item|qty|quantity|disc|tax)|items?\s*:|qty)"
STOP = r"(?i)\b(sub\s*-?\s*total|total|tax|pb\s*1|ppn|cash|tunai|change|kembali|net\s*amt)"
WORD = r"[A-Za-z]{2,}"
# A line that matches a pattern has one of these, in lower case. They are looked for first, as most lines have none.
SUBTOTAL_HAS, GRAND_HAS, TOTAL_HAS = ("sub", "net", "total"), ("grand",), ("otal", "jumlah", "amount")
TAX_HAS, SERVICE_HAS, DISCOUNT_HAS = ("tax", "pb", "ppn", "vat", "pajak"), ("sc", "s.c", "svc", "serv"), ("disc", "potongan")
STOP_HAS = ("total", "tax", "pb", "ppn", "cash", "tunai", "change", "kembali", "net")
LEADING_QUANTITY = r"^\s*(\d{1,2})\s*[xX]?\s+(.*)$"


def matches(line: Column, low: Column, pattern: str, has: tuple[str, ...]) -> Column:
    """Whether a line matches; low: the line in lower case."""
    return functools.reduce(operator.or_, map(low.contains, has)) & line.rlike(pattern)


#: What Spark's regular expressions call the end of a text, and any character but a line's end.
END, IN_LINE = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)", r"[^\n\r\x85\u2028\u2029]"
FIND_QUANTITY = re.compile(LEADING_QUANTITY.replace(".*", IN_LINE + "*").replace("$", END), re.ASCII)
QUANTITY = r"^[ \t-\r]*(?P<quantity>[0-9]{1,2})[ \t-\r]*[xX]?[ \t-\r]+"
FIND_EDGES = re.compile(rf"^[ @:x-]+|[ @:x-]+{END}")
LABELS = ("sub", "grand", "total", "tax", "svc", "disc")
FLAGS = (*LABELS, "stop")
PARTS = StructType([*(StructField(k, BooleanType()) for k in FLAGS), StructField("value", DoubleType()), StructField("name", StringType()), StructField("quantity", DoubleType()), StructField("line_total", DoubleType())])


def in_low(pattern: str) -> str:
    """A label pattern as Arrow takes it, for texts in lower case (``low_words``)."""
    return pattern.replace("(?i)", "").replace(r"\w", "[a-z0-9_]").replace(r"\s", r"[ \t-\r]").replace("(?<![a-z])", "(?:^|[^a-z])")


IN_LOW = tuple(map(in_low, (SUBTOTAL, GRAND, TOTAL, TAX, SERVICE, DISCOUNT, STOP)))
HAS_LABEL = "|".join(dict.fromkeys([*SUBTOTAL_HAS, *GRAND_HAS, *TOTAL_HAS, *TAX_HAS, *SERVICE_HAS, *DISCOUNT_HAS, *STOP_HAS])).replace(".", r"\.")


def low_words(line: str) -> str:
    """A line in lower case. Beyond ASCII, letters and digits, and marks on one, become Z, all else a sign: so Arrow's \\b tells apart what Spark's does."""
    if line.isascii():
        return line.lower()
    out, word = [], False
    for ch in line:
        kind = "ASCII" if ch < "\x80" else category(ch)
        if kind != "Mn":
            word = ch.isalnum() if kind == "ASCII" else kind[0] == "L" or kind == "Nd"
        out.append(ch.lower() if kind == "ASCII" else "Z" if word else "\x80")
    return "".join(out)


def labels_of(lines: pa.Array) -> np.ndarray:
    """[lines, FLAGS]: which labels each line has, and whether items stop at it."""
    low = pc.ascii_lower(lines)
    at = np.flatnonzero(pc.match_substring_regex(low, HAS_LABEL).to_numpy(zero_copy_only=False))
    low = low.take(pa.array(at))
    low = pc.if_else(pc.string_is_ascii(low), low, pa.array(map(low_words, low.to_pylist()), pa.string()))
    out = np.zeros((len(lines), len(FLAGS)), bool)
    for k, pattern in enumerate(IN_LOW):
        out[at, k] = pc.match_substring_regex(low, pattern).to_numpy(zero_copy_only=False)
    out[at, FLAGS.index("total")] &= ~pc.match_substring_regex(low, in_low(NOT_TOTAL)).to_numpy(zero_copy_only=False)
    return out


def item_of(line: str) -> tuple[str, float | None]:
    """Name and quantity of an item's line: what stands before the first amount, without a leading quantity."""
    counted = FIND_QUANTITY.match(line)
    name = FIND_EDGES.sub("", FIND_AMOUNTS.split(counted[2] if counted else line, maxsplit=1)[0])
    return name, float(counted[1]) if counted else None


def items_of(lines: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``item_of`` of each line; null where the line or the name has no word. An amount begins with its first digit, or with a sign or bracket before it: of
    these only the bracket is no edge of a name, so lines with one, or beyond ASCII, or with an end inside, are looked at one by one."""
    rest = pc.replace_substring_regex(lines, QUANTITY, "", max_replacements=1)
    quantity = pc.struct_field(pc.extract_regex(lines, QUANTITY), [0]).cast(pa.float64())
    name = pc.ascii_trim(pc.replace_substring_regex(rest, "(?s)[0-9].*", ""), " @:x-")
    odd = pc.or_(pc.invert(pc.string_is_ascii(lines)), pc.or_(pc.match_substring_regex(lines, "[\\n\\r]"), pc.match_substring_regex(rest, r"^[^0-9]*\([0-9]")))
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(at):
        some = [item_of(x) for x in lines.take(pa.array(at)).to_pylist()]
        name = pc.replace_with_mask(name, odd, pa.array([x for x, _ in some], pa.string()))
        quantity = pc.replace_with_mask(quantity, odd, pa.array([x for _, x in some], pa.float64()))
    ok = pc.and_(pc.match_substring_regex(lines, WORD), pc.match_substring_regex(name, WORD))
    return pc.if_else(ok, name, pa.scalar(None, pa.string())), pc.if_else(ok, quantity, pa.scalar(None, pa.float64()))


@F.arrow_udf(ArrayType(PARTS))
def line_parts(lines: pa.Array) -> pa.Array:
    """One struct for each line: its labels, its value (last amount, else the next line's first), and an item's name, quantity and line total where it can be one."""
    row, each = flat(lines)
    each = each.cast(pa.string()).fill_null("")
    found = [tokens_in(x) for x in each.to_pylist()]
    shown = np.array([len(x) > 0 for x in found], bool)
    last = values_of(pa.array([x[-1] if x else None for x in found], pa.string()))
    # the next line's first amount, where it is of the same record
    after = np.append(row[1:] == row[:-1], False) if len(row) else shown
    first = values_of(pa.array([found[i + 1][0] if x and found[i + 1] else None for i, x in enumerate((after & ~shown).tolist())], pa.string()))
    names = [pa.nulls(len(each), t) for t in (pa.string(), pa.float64())]
    if shown.any():
        names = [pc.replace_with_mask(x, pa.array(shown), y) for x, y in zip(names, items_of(each.filter(pa.array(shown))))]
    columns = [*map(pa.array, labels_of(each).T), pc.coalesce(last, first), *names, last]
    return relisted(lines, pa.StructArray.from_arrays(columns, PARTS.names))


STATE = "struct<sub_taken:boolean,sub:double,grand:double,total:double,tax:double,svc:double,disc:double>"


def totals(facts: Column) -> Column:
    """Fold over the lines. The first subtotal line is final even without a value; the other fields wait for one."""
    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(False).alias("sub_taken"), *[nothing.alias(k) for k in ("sub", "grand", "total", "tax", "svc", "disc")]).cast(STATE)

    def step(s: Column, x: Column) -> Column:
        sub = x["sub"] & ~s["sub_taken"]
        grand = ~sub & x["grand"] & s["grand"].isNull()
        total = ~sub & ~grand & x["total"]
        rest = ~sub & ~grand & ~total
        tax = rest & x["tax"] & s["tax"].isNull()
        svc = rest & ~tax & x["svc"] & s["svc"].isNull()
        disc = rest & ~tax & ~svc & x["disc"] & s["disc"].isNull()
        keep = lambda on, k: F.when(on, x["value"]).otherwise(s[k]).alias(k)
        return F.struct(
            (s["sub_taken"] | sub).alias("sub_taken"), keep(sub, "sub"), keep(grand, "grand"), keep(total & s["total"].isNull(), "total"), keep(tax, "tax"), keep(svc, "svc"), keep(disc, "disc")
        ).cast(STATE)

    # a line without a label changes nothing
    labelled = F.filter(facts, lambda x: x["sub"] | x["grand"] | x["total"] | x["tax"] | x["svc"] | x["disc"])
    return F.aggregate(labelled, start, step)


def line_items(parts: Column) -> Column:
    """Items of the lines before the first stop line."""
    stop = F.array_position(F.transform(parts, lambda x: x["stop"]), True)
    head = F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts)
    item = lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), F.lit(None).cast("double").alias("unit_price"), x["line_total"].alias("line_total"))
    return F.transform(F.filter(head, lambda x: x["name"].isNotNull()), item)


def with_extraction(df: DataFrame, lines: str = "lines", out: str = "receipt") -> DataFrame:
    """Adds the record extracted from an array of lines."""
    # each line is read once; later expressions refer to the column
    df = df.withColumn("__parts", line_parts(F.col(lines)))
    df = df.withColumn("__t", totals(F.col("__parts")))
    t, none = F.col("__t"), F.lit(None).cast("string")
    fields = [none.alias("store_name"), line_items(F.col("__parts")).alias("items"), t["sub"].alias("subtotal"), t["disc"].alias("discount"), t["tax"].alias("tax"), t["svc"].alias("service_charge"), F.coalesce(t["grand"], t["total"]).alias("total"), none.alias("currency")]
    return df.withColumn(out, F.struct(*fields).cast(RECEIPT)).drop("__t", "__parts")
