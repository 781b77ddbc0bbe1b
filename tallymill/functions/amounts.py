"""Money, quantity and currency expressions. Amounts may be printed in full-width or other compatibility forms (see unicode.plain)."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import digits, first_of, let, strip
from .unicode import plain, plain_forms

# What must be recognised for equal results.
CURRENCY_WORDS = r"(?i)\b(rp|idr|usd|sgd|myr|eur|krw|won|php|thb|vnd)\b\.?"
CURRENCY_IN_TEXT = r"\b(rp|idr|usd|sgd|myr|rm|eur|krw|php|thb|vnd)\b"
WORD_CODES = {"rp": "IDR", "idr": "IDR", "usd": "USD", "sgd": "SGD", "myr": "MYR", "rm": "MYR", "eur": "EUR", "krw": "KRW", "php": "PHP", "thb": "THB", "vnd": "VND"}
SYMBOL_CODES = {"€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW", "₫": "VND", "฿": "THB", "₱": "PHP", "$": "USD"}
# Fixed values as well: what counts as a number.
#: A printed amount: digit groups of three with separators, groups with blanks, or a plain number.
AMOUNT = r"-?\(?\d{1,3}(?:[.,]\s?\d{3}(?!\d))+(?:[.,]\d{1,2})?\)?|-?\d{1,3}(?:\s\d{3})+(?![\d.,])|-?\d+(?:[.,]\d{1,2})?"
NUMBER_TOKEN = r"\d[\d.,\s]*\d|\d"
#: What such tokens have beside digits: separators and the characters of \s.
NOT_DIGITS = "., \t\n\x0b\f\r"


def parse_amount(c: Column) -> Column:
    """The first number of a printed amount, or null. A last separator before one or two digits is the decimal point, every other one groups digits."""
    return parse_narrow(plain(c))


def parse_narrow(c: Column) -> Column:
    """``parse_amount`` of a text without compatibility forms."""
    symbols = "".join(SYMBOL_CODES)
    clean = strip(F.translate(F.regexp_replace(c, CURRENCY_WORDS, " "), symbols, " " * len(symbols)))

    def of_clean(text: Column) -> Column:
        return let(F.regexp_extract(text, r"-?\s*\d[\d.,\s]*", 0), lambda run: of_run(run, run.startswith("-") | (text.startswith("(") & text.endswith(")"))))

    def of_run(run: Column, negative: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(run, r"[\s-]", ""), r"^[.,]+|[.,]+$", "")
        return F.when(run != "", let(number, lambda n: F.when(negative, -of_number(n)).otherwise(of_number(n))))

    def of_number(number: Column) -> Column:
        decimals = F.regexp_extract(number, r"[.,](\d{1,2})$", 1)
        whole = F.regexp_replace(F.regexp_replace(number, r"[.,]\d{1,2}$", ""), "[.,]", "")
        return F.concat(F.lit("0"), whole, F.lit("."), decimals, F.lit("0")).try_cast("double")

    return let(clean, of_clean)


def parse_amount_list(arr: Column) -> Column:
    """The first member that parses."""
    return first_of(F.filter(F.transform(arr, parse_amount), lambda x: x.isNotNull()))


def parse_quantity(c: Column) -> Column:
    """The first number of a quantity; a comma is a decimal point and signs do not count."""
    return F.nullif(F.replace(F.regexp_extract(c, r"\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def amounts_in(line: Column) -> Column:
    """All amounts of a line, without signs, in order."""
    return F.transform(F.regexp_extract_all(plain(line), F.lit(AMOUNT), F.lit(0)), amount_of)


def amount_of(token: Column) -> Column:
    """``parse_narrow`` of a match of AMOUNT, without its sign. It begins with a sign, bracket or digit, ends with a digit or bracket and has only these,
    separators and blanks, so no pattern is needed."""

    def of_number(n: Column) -> Column:
        whole = lambda decimals: F.translate(F.substring(n, F.lit(1), F.length(n) - (decimals + 1)), ".,", "")
        point = lambda decimals: F.substring(n, -(decimals + 1), 1).isin(".", ",")
        shown = lambda decimals: F.concat(F.lit("0"), whole(decimals), F.lit("."), F.substring(n, -decimals, decimals), F.lit("0"))
        return F.when(point(2), shown(2)).when(point(1), shown(1)).otherwise(F.concat(F.lit("0"), F.translate(n, ".,", ""), F.lit(".0"))).try_cast("double")

    return let(F.translate(token, "-() \t\n\x0b\f\r", ""), of_number)


#: The same patterns for Arrow batches.
FIND_AMOUNTS, FIND_NUMBERS = re.compile(AMOUNT, re.ASCII), re.compile(NUMBER_TOKEN, re.ASCII)
DROP_NOT_DIGITS = str.maketrans("", "", NOT_DIGITS)


@functools.cache
def plain_table() -> dict[int, str]:
    return str.maketrans(plain_forms())


def tokens_in(line: str | None) -> list[str]:
    """The printed amounts of one line; none for null."""
    if not line:
        return []
    return FIND_AMOUNTS.findall(line if line.isascii() else line.translate(plain_table()))


def values_of(tokens: pa.Array) -> pa.Array:
    """``amount_of`` of tokens; null stays null."""
    n = pc.replace_substring_regex(tokens, r"[-() \t-\r]", "")
    n = pc.replace_substring_regex(pc.replace_substring_regex(n, r"[.,]([0-9]{1,2})$", r"_\1"), "[.,]", "")
    return pa.array([x and float(x) for x in pc.replace_substring(n, "_", ".").to_pylist()], pa.float64())


def relisted(lists: pa.Array, values: pa.Array) -> pa.Array:
    """One value for each member of an array of lists, as lists of the same lengths; null stays null."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=lists.is_null())


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def amounts_of_lines(lines: pa.Array) -> pa.Array:
    """``amounts_in`` of each line of an array, a batch of records at a time."""
    tokens = pa.array(map(tokens_in, lines.flatten().to_pylist()), pa.list_(pa.string()))
    return relisted(lines, relisted(tokens, values_of(tokens.flatten())))


def detect_currency(text: Column) -> Column:
    """ISO code: symbols first, in their fixed order, then the leftmost code word; else null."""
    low = F.lower(text)
    word = F.regexp_extract(low, CURRENCY_IN_TEXT, 1)
    codes = F.create_map(*[F.lit(x) for kv in WORD_CODES.items() for x in kv])
    found = F.when(low.contains(next(iter(SYMBOL_CODES))), next(iter(SYMBOL_CODES.values())))
    for symbol, code in list(SYMBOL_CODES.items())[1:]:
        found = found.when(low.contains(symbol), code)
    return found.when(word != "", F.try_element_at(codes, word))


def money_equal(a: Column, b: Column, abs_tol: float = 1.0, rel_tol: float = 0.0) -> Column:
    """Never null: two absent values are equal, one absent value is not."""
    near = F.abs(a - b) <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(near, a.isNull() & b.isNull())


def numbers_of(lines: list[str] | None) -> list[str] | None:
    """``number_strings`` of one record."""
    if lines is None or None in lines:
        return None
    out: dict[str, None] = {}
    for token in FIND_NUMBERS.findall("\x1e".join(lines)):
        if token.isdigit():
            out[token] = None
            continue
        # a token begins and ends with a digit and has only digits, separators and blanks
        out[token.translate(DROP_NOT_DIGITS)] = None
        if token.endswith((".00", ",00")):
            out[token[:-3].translate(DROP_NOT_DIGITS)] = None
        parts = token.split()
        if len(parts) > 1:
            out.update(dict.fromkeys(x.translate(DROP_NOT_DIGITS) for x in parts))
    return list(out)


@F.arrow_udf(ArrayType(StringType()))
def number_strings(lines: pa.Array) -> pa.Array:
    """All different digit strings that the number tokens of an array's lines can stand for: whole, without a printed .00, and each blank-separated part."""
    return pa.array(map(numbers_of, lines.to_pylist()), pa.list_(pa.string()))


def amount_present(value: Column, raw: Column, numbers: Column) -> Column:
    """Whether the printed form, or the value rounded half-even, is among the digit strings. Never null."""
    candidates = F.filter(F.array(digits(raw), F.bround(value).cast("bigint").cast("string")), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.arrays_overlap(candidates, numbers), F.lit(False))


def format_money(c: Column) -> Column:
    """Grouped, at most two decimals, trailing zeros cut; null is a dash."""
    return F.coalesce(F.regexp_replace(F.format_number(c, 2), r"\.?0+$", ""), F.lit("-"))
