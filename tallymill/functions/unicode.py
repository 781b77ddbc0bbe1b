"""Unicode normal forms, equal to ``unicodedata`` for every text.

Whole texts with characters beyond ASCII go through ``unicodedata`` in Arrow batches (``normal_form``). Where only each character's own form matters, as for
amounts and normal names, it is looked up without Python in tasks (``per_character``): one that becomes a single character by ``translate``, one that becomes several
by its place in a constant array. Null gives null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from unicodedata import category, combining, decomposition, normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters above this have no other form (checked by a test over all of them).
LAST = 0x30000
#: Places in a table are written as characters of this private plane.
PLACES = 0xF0000
#: Vowel and tail letters of Hangul, and how many there are of each.
VOWEL, TAIL = 0x1161, 0x11A7
N_VOWEL, N_TAIL = 21, 28


def every() -> Iterable[str]:
    return (chr(x) for x in range(0x80, LAST) if not 0xD800 <= x < 0xE000)


@functools.cache
def forms(kind: str) -> dict[str, str]:
    """character -> its form, where that is another one."""
    return {c: n for c in every() if (n := normalize(kind, c)) != c}


@functools.cache
def composites() -> dict[str, dict[str, str]]:
    """second character -> first character -> what both become."""
    out: dict[str, dict[str, str]] = {}
    for c in every():
        parts = decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            a, b = (chr(int(x, 16)) for x in parts)
            if normalize("NFC", a + b) == c:
                out.setdefault(b, {})[a] = c
    return out


@functools.cache
def marks() -> dict[str, int]:
    """character -> combining class, where it is not 0."""
    return {c: k for c in every() if (k := combining(c))}


@functools.cache
def joining() -> str:
    """Characters whose form begins with one that can move before, or merge with, what stands before it."""
    second = composites().keys() | {chr(VOWEL + k) for k in range(N_VOWEL)} | {chr(TAIL + k) for k in range(1, N_TAIL)}
    return "".join(c for c in every() if (d := normalize("NFKD", c)[0]) in marks() or d in second)


def has_any(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "") != c


def place(ch: Column, keys: Iterable[str]) -> Column:
    """Place of a character among the keys; null if it is none. No lambda function: Python functions do not take arguments with nested ones."""
    keys = "".join(keys)
    moved = F.translate(ch, keys, "".join(chr(PLACES + i) for i in range(len(keys))))
    return F.when(moved != ch, F.ascii(moved) - PLACES)


def entry(values: Iterable[str], at: Column) -> Column:
    return F.get(F.split(F.lit("\x01".join(values)), "\x01"), at)


def form_of(ch: Column, table: dict[str, str]) -> Column:
    return F.coalesce(entry(table.values(), place(ch, table)), ch)


NOT_ASCII = r"[^\x00-\x7F]"


@functools.cache
def plain_forms() -> dict[str, str]:
    """NFKC forms with an ASCII character, also in upper case, or a currency sign: all that matter for amounts and normal names."""
    return {a: b for a, b in forms("NFKC").items() if any(x < "\x80" or category(x) == "Sc" for x in b + b.upper())}


def per_character(c: Column, form: dict[str, str] | None = None) -> Column:
    """Each character's form, by default that of NFKC: equal to ``nfkc`` but for sequences that merge, such as a letter and an accent."""
    form = forms("NFKC") if form is None else form
    single = {a: b for a, b in form.items() if len(b) == 1}
    several = {a: b for a, b in form.items() if len(b) > 1}
    # what a single character becomes has no other form, so the order of both steps does not matter
    narrow = F.translate(c, "".join(single), "".join(single.values()))
    wide = F.array_join(F.transform(F.split(narrow, ""), lambda ch: form_of(ch, several)), "")
    return F.when(~c.rlike(NOT_ASCII), c).when(has_any(c, "".join(several)), wide).otherwise(narrow)


def plain(c: Column) -> Column:
    """A text's characters that amounts and normal names are read from, as NFKC gives them."""
    return per_character(c, plain_forms())


def without_accented(c: Column) -> Column:
    """ASCII letters and digits that the mark after them turns into another character, replaced by a blank."""
    pairs = [(mark, "".join(a for a in firsts if a < "\x80" and a.isalnum())) for mark, firsts in composites().items()]
    return F.when(~c.rlike(NOT_ASCII), c).otherwise(F.regexp_replace(c, "|".join(f"[{a}](?={mark})" for mark, a in pairs if a), " "))


@functools.cache
def normalizer(form: str):
    """Arrow UDF: each text in a normal form."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([x and normalize(form, x) for x in texts.to_pylist()], pa.string())

    return normal


def normal_form(c: Column, form: str) -> Column:
    """A string column in a normal form. ASCII texts are not sent to Python; bytes that are no UTF-8 become U+FFFD."""
    valid = F.make_valid_utf8(c)
    beyond = F.octet_length(valid) != F.length(valid)
    return F.when(beyond, normalizer(form)(F.when(beyond, valid))).otherwise(valid)


def nfkc(c: Column) -> Column:
    """NFKC of a string column."""
    return normal_form(c, "NFKC")


def normalize_unicode(df: DataFrame, *names: str) -> DataFrame:
    """NFKC of string columns."""
    return df.withColumns({n: nfkc(F.col(n)) for n in names})
