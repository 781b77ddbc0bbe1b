import random
import re
from unicodedata import normalize

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymill.functions import amounts as A
from tallymill.functions import names as N
from tallymill.functions.lcs import Names, lcs_length
from tallymill.functions import unicode as U

AMOUNTS = {
    "81.500": 81500, "37,250": 37250, "4,310,900": 4310900, "6.045.700": 6045700, "8125.00": 8125, "9,75": 9.75, "3.408,19": 3408.19, "7,206.84": 7206.84,
    "Rp. 18.350": 18350, "$7.45": 7.45, "@64,500": 64500, "-71.300": -71300, "-8 450": -8450, "(00)": 0, "[208,150]": 208150, "(7,300)": -7300,
    "": None, "due": None, "RM": None, "--": None, None: None,
}


def test_parse_amount(column):
    assert column(A.parse_amount, list(AMOUNTS)) == list(AMOUNTS.values())


def test_parse_amount_list(column):
    assert column(A.parse_amount_list, [["n/a", "2,415,000", "75,500"], [], None], "array<string>") == [2415000, None, None]


def test_parse_quantity(column):
    cases = {"14": 14, "6X": 6, "x8": 8, "3.00": 3, "(7": 7, "5.00xPACKs": 5, "2,5": 2.5, "6.000": 6, "each": None, None: None}
    assert column(A.parse_quantity, list(cases)) == list(cases.values())


def test_detect_currency(column):
    cases = {"BILL Rp 8.200": "IDR", "Paid $3.10": "USD", "gbp then €": "EUR", "GRAPEFRUIT": None, "Rp9": None, "yuan": None, "RM 8 or THB": "MYR", None: None}
    assert column(A.detect_currency, list(cases)) == list(cases.values())


def test_amounts_in(column):
    assert column(A.amounts_in, ["3 87,500", "DUE 41 000", "DUE 306, 215", "DUE", "-8 and 2.718,50"]) == [[3, 87500], [41000], [306215], [], [8, 2718.5]]


def test_norm_name(column):
    assert column(N.norm_name, [" k.lat  deal ", "MINT TEA ( XL )", "茶", None]) == ["K LAT DEAL", "MINT TEA XL", "", ""]


def test_money_equal(spark):
    rows = [(100.0, 100.4), (100.0, 101.0), (None, None), (None, 5.0), (100000.0, 100400.0)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    assert [r[0] for r in df.select(A.money_equal(F.col("a"), F.col("b"), 0.5)).collect()] == [True, False, True, False, False]
    assert [r[0] for r in df.select(A.money_equal(F.col("a"), F.col("b"), 1.0, 0.005)).collect()] == [True, True, True, False, True]


def test_number_strings_and_presence(spark):
    df = spark.createDataFrame([(["A 1.200,00 x", "12 5"],)], "lines array<string>").withColumn("n", A.number_strings(F.col("lines")))
    assert set(df.first().n) == {"120000", "1200", "125", "12", "5"}
    probe = lambda v, raw: df.select(A.amount_present(F.lit(v).cast("double"), F.lit(raw).cast("string"), F.col("n"))).first()[0]
    assert [probe(1200.0, None), probe(12.5, None), probe(11.5, None), probe(None, None), probe(9.0, "1.200"), probe(9.0, "")] == [True, True, True, False, True, False]


def test_format_money(column):
    assert column(A.format_money, [1234.5, 100.0, 1200.25, 0.0, None], "double") == ["1,234.5", "100", "1,200.25", "0", "-"]


@pytest.mark.parametrize(("a", "b", "want"), [("KITTEN", "SITTING", 8 / 13), ("", "", 1.0), ("A", "", 0.0), ("ABC", "ABC", 1.0), ("AB", "BA", 0.5)])
def test_similarity_native_equals_bit_parallel(spark, a, b, want):
    native = spark.range(1).select(N.name_similarity(F.lit(a), F.lit(b))).first()[0]
    assert native == pytest.approx(want)
    assert (1.0 if a == b else 2 * lcs_length(a, b) / max(1, len(a) + len(b))) == pytest.approx(want)


def names_at_random(n, seed, most=80):
    r = random.Random(seed)
    return ["", *{"".join(r.choice("AB C1" if r.random() < 0.5 else "ABCDEFGH 0123456789") for _ in range(r.choice([1, 3, 8, 20, 63, 64, 65, most]))) for _ in range(n)}]


def by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("more", [[], ["ÉTÉ", "THÉ É"]])
def test_lanes_equal_the_table(more):
    names = names_at_random(60, 1) + more
    known = Names(names)
    a, b = np.divmod(np.arange(len(names) ** 2), len(names))
    want = [by_table(names[i], names[j]) for i, j in zip(a, b, strict=True)]
    assert known.lcs(a, b).tolist() == want
    assert known.lcs(a[:0], b[:0]).tolist() == []
    both = [len(names[i]) + len(names[j]) for i, j in zip(a, b, strict=True)]
    assert known.similarity(a, b).tolist() == [2 * w / n if n else 1.0 for w, n in zip(want, both, strict=True)]


@pytest.mark.parametrize("more", [[], ["ÉTÉ", "THÉ É"]])
def test_windows_equal_the_table(more):
    names = names_at_random(25, 2, 70) + more

    def best(a, b):
        if not a or not b:
            return float(a == b)
        ways = [(a, b)] if len(a) < len(b) else [(b, a)] if len(a) > len(b) else [(a, b), (b, a)]
        return max(2 * by_table(s, w) / (len(s) + len(w)) for s, long in ways for i in range(1 - len(s), len(long)) for w in [long[max(0, i) : i + len(s)]])

    known = Names(names)
    a, b = np.divmod(np.arange(len(names) ** 2), len(names))
    assert known.best_window(a, b).tolist() == [best(names[i], names[j]) for i, j in zip(a, b, strict=True)]


def test_name_in_lines(spark):
    cases = [("MINT TEA", ["2 MINT TEA 52", "X"], True), ("MINT TEE", ["9", "2 MINT TEA 52 000"], True), ("CARROT", ["XYZ", ""], False), ("", [], True), ("", None, True), ("A", None, False), ("A", [""], False), (None, ["x"], True)]
    df = spark.createDataFrame([(i, n, ls) for i, (n, ls, _) in enumerate(cases)], "i int, n string, ls array<string>").coalesce(1)
    assert [r[0] for r in df.select(N.name_in_lines("n", "ls"), "i").orderBy("i").collect()] == [w for *_, w in cases]


def test_normalize_unicode(spark):
    df = spark.createDataFrame([(1, "１２", "a"), (2, "ok", None), (3, None, "ﬁ")], "i int, a string, b string")
    assert {r.i: (r.a, r.b) for r in U.normalize_unicode(df, "a", "b").collect()} == {1: ("12", "a"), 2: ("ok", None), 3: (None, "fi")}


def test_nfkc_of_all_characters(spark):
    every = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    got = spark.createDataFrame(pd.DataFrame({"s": every})).select("s", U.nfkc(F.col("s")).alias("n"), U.per_character(F.col("s")).alias("p")).toPandas()
    want = [normalize("NFKC", x) for x in got.s]
    assert len(got) == len(every) and got.n.tolist() == want and got.p.tolist() == want
    names = spark.createDataFrame(pd.DataFrame({"s": every})).select("s", N.norm_name(F.col("s")).alias("n")).toPandas()
    assert names.n.tolist() == [" ".join(re.sub("[^A-Z0-9]+", " ", normalize("NFKC", x).upper()).split()) for x in names.s]


def test_nfkc_of_sequences(spark):
    rng = random.Random(7)
    firsts = sorted({a for x in U.composites().values() for a in x})
    pool = [*U.joining(), *U.forms("NFKC"), *"aeiouAEOcnsqd =<>" * 40, *[chr(0x1100 + k) for k in range(19)] * 20, *[chr(0xAC00 + 28 * k) for k in range(300)]]
    texts = ["", "e\u0327\u0301", "한글", "\u0301\u0327", "a" + "\u0301\u0316" * 500]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    texts += [rng.choice(firsts) + "".join(rng.choice(list(U.composites())) for _ in range(rng.randint(1, 4))) for _ in range(5000)]
    got = spark.createDataFrame(pd.DataFrame({"s": [*texts, None]})).select("s", U.nfkc(F.col("s")).alias("n")).collect()
    assert all(r.n == (None if r.s is None else normalize("NFKC", r.s)) for r in got)


def test_names_and_amounts_of_many_character_forms(spark, column):
    def plain(x):
        return " ".join(re.sub("[^A-Z0-9]+", " ", normalize("NFKC", x or "").upper()).split())

    names = ["㎏ ½ ①", "⑽ ﬁg", "cafe\u0301 bar", "CAFÉ bar", "⒛ ㍿", "  ", "x\x02y", None, "a\u0301b\u0323", "ﬃ℡"]
    assert column(N.norm_name, names) == [plain(x) for x in names]
    lists = [names, [], None, ["é"], ["plain", "two  words "]]
    assert column(N.norm_names, lists, "array<string>") == [None if x is None else [plain(y) for y in x] for x in lists]
    assert column(A.parse_amount, ["⒓", "㏠ 7", "⑽", "🄂5", "RM ㉑.50"]) == [12, 1, -10, 1.5, 21.5]
