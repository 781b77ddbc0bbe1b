"""Item names: normal form and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .lcs import Names
from .text import characters
from .unicode import plain, without_accented


def norm_name(c: Column) -> Column:
    """Upper case, letters A-Z and digits only of the NFKC form, single blanks; null gives the empty text. An accented letter is none of A-Z, also where
    the accent is a character of its own, unless another mark stands between them."""
    return F.trim(F.regexp_replace(F.upper(without_accented(plain(F.coalesce(c, F.lit(""))))), "[^A-Z0-9]+", " "))


def norm_names(names: Column) -> Column:
    """``norm_name`` of each member of an array, all in one text; null gives null."""
    end = "\x02"
    joined = F.array_join(F.transform(names, lambda x: F.translate(F.coalesce(x, F.lit("")), end, " ")), end)
    normal = F.regexp_replace(F.upper(without_accented(plain(joined))), f"[^A-Z0-9{end}]+", " ")
    return F.when(F.size(names) == 0, F.array().cast("array<string>")).otherwise(F.split(F.trim(F.regexp_replace(normal, f" ?{end} ?", end)), end))


def ascii_or_normal(names: Column) -> Column:
    """An array's names as they are where all are ASCII, else their normal forms: ``numbered`` makes the former normal, each different name of a batch once."""
    joined = F.array_join(names, "")
    return F.when(F.is_valid_utf8(joined) & (F.octet_length(joined) == F.length(joined)), names).otherwise(norm_names(names))


def normal_ascii(names: pa.Array) -> pa.Array:
    """``norm_name`` of ASCII names."""
    return pc.ascii_trim(pc.replace_substring_regex(pc.ascii_upper(names), "[^A-Z0-9]+", " "), " ")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one row of the table after another."""
    across = characters(b)
    width = F.size(across)

    def row(above: Column, ch: Column) -> Column:
        corner = F.zip_with(across, F.slice(above, F.lit(1), width), lambda c, d: F.struct((c == ch).alias("same"), (d + 1).alias("met")))
        cells = F.zip_with(corner, F.slice(above, F.lit(2), width), lambda x, up: F.struct(x["same"].alias("same"), x["met"].alias("met"), up.alias("up")))
        return F.aggregate(cells, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.when(x["same"], x["met"]).otherwise(F.greatest(x["up"], F.element_at(done, -1))))))

    table = F.aggregate(characters(a), F.array_repeat(F.lit(0), width + 1), row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(table, -1))


def name_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Insertion/deletion similarity 2 LCS / (|a| + |b|) of normal names; 1 for two empty names. Null where lengths alone rule ``least`` out."""
    both = F.length(a) + F.length(b)
    possible = 2.0 * F.least(F.length(a), F.length(b)) >= least * both
    return F.when(a == b, 1.0).when(possible, 2.0 * common_subsequence(a, b) / both)


#: Pairs of names whose windows are compared at once: bounds the lanes.
PAIRS = 20_000
NEAR = 0.8


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of an array of lists."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def numbered(*columns: pa.Array, normal: bool = True) -> tuple[Names, list[np.ndarray]]:
    """The different names of the columns, null as the empty one, and each column as their numbers. normal: whether the names are normal, else those of ``ascii_or_normal``."""
    coded = pc.dictionary_encode(pa.concat_arrays([c.cast(pa.string()).fill_null("") for c in columns]))
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return Names((coded.dictionary if normal else normal_ascii(coded.dictionary)).to_pylist()), np.split(coded.indices.to_numpy().astype(np.int64), cuts)


@F.arrow_udf(BooleanType())
def name_in_lines(names: pa.Array, lines: pa.Array) -> pa.Array:
    """Whether a normal name stands in one of the normal lines, up to 20 % of changes; an empty name does."""
    row, each = flat(lines)
    known, (name, line) = numbered(names, each)
    out = known.size[name] == 0
    pair, at = np.unique(np.stack([name[row], line], 1), axis=0, return_inverse=True)
    near = np.asarray([known.names[a] in known.names[b] for a, b in pair.tolist()], bool)
    # the rows of a name that stands there as it is need no search
    done = out.copy()
    np.logical_or.at(done, row, near[at] & (known.size[line] > 0))
    open_ = np.zeros(len(pair), bool)
    open_[at[~done[row]]] = True
    todo = np.flatnonzero(open_)
    for a in range(0, len(todo), PAIRS):
        some = todo[a : a + PAIRS]
        near[some] = known.best_window(pair[some, 0], pair[some, 1]) >= NEAR
    near[todo] &= known.size[pair[todo, 1]] > 0
    found = near[at] & ~done[row]
    np.logical_or.at(done, row, found)
    return pa.array(done)
