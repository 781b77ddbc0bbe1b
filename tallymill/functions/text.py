"""String helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambda functions, where Spark shares no common parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def digits(c: Column) -> Column:
    """The digits of a text; null gives the empty text."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def first_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))
