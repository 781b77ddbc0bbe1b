"""Items are matched a batch at a time: as one record after another, and names made normal once for each different one."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tallymill.functions import names as N
from tallymill.functions.amounts import money_equal
from tallymill.functions.lcs import lcs_length
from tallymill.operators import match, score
from tallymill.types import ITEM


def test_ascii_names_are_made_normal_in_the_batch(column):
    odd = ["", " a-b ", "Tea\x02x", "x\ty", "A  1.5", "ok"]
    assert N.normal_ascii(pa.array(odd)).to_pylist() == column(N.norm_name, odd)
    lists = [odd, ["a-b", None], ["café", "a-b"], [], None]
    assert column(N.ascii_or_normal, lists, "array<string>") == [odd, ["a-b", None], ["CAF", "A B"], [], None]


def one_by_one(pred, gold, near):
    norm = lambda x: N.normal_ascii(pa.array([x["name"] or ""]))[0].as_py()
    found = []
    for i, a in enumerate(pred):
        for j, b in enumerate(gold):
            x, y = norm(a), norm(b)
            sim = 2 * lcs_length(x, y) / (len(x) + len(y)) if x + y else 1.0
            if sim >= 0.6:
                found.append((sim, i, j))
    taken = []
    for sim, i, j in sorted(found, reverse=True):
        if near(i, j) and not any(i == x["i"] or j == x["j"] for x in taken):
            taken.append({"i": i, "j": j, "sim": sim})
    return taken


def test_batches_match_like_single_records(spark):
    r = random.Random(5)
    item = lambda: {"name": r.choice(["tea", "teas", "Tea!", "iced tea", "", None, "bread"]), "quantity": 1.0, "unit_price": None, "line_total": r.choice([1.0, 1.4, 2.0, None, math.nan, math.inf])}
    some = lambda: None if r.random() < 0.1 else [item() for _ in range(r.randint(0, 6))]
    data = [(k, some(), some()) for k in range(200)]
    df = spark.createDataFrame(data, f"k int, a array<{ITEM}>, b array<{ITEM}>").coalesce(1)
    amounts = [1.0, 1.4, 2.0, None, math.nan, math.inf]
    pairs = spark.createDataFrame([(x, y) for x in amounts for y in amounts], "x double, y double")
    same = {(str(p.x), str(p.y)): p.ok for p in pairs.select("x", "y", money_equal(F.col("x"), F.col("y"), match.PRICE_TOL).alias("ok")).collect()}
    for row in df.select("k", match.matches(F.col("a"), F.col("b")).alias("m")).collect():
        _, a, b = data[row.k]
        a, b = a or [], b or []
        near = lambda i, j: same[str(a[i]["line_total"]), str(b[j]["line_total"])]  # noqa: B023, E731
        assert [x.asDict() for x in row.m.pairs] == one_by_one(a, b, near)
        assert [x.asDict() for x in row.m.name_pairs] == one_by_one(a, b, lambda *_: True)
    assert score.with_matches(spark.createDataFrame([], f"pred struct<items:array<{ITEM}>>, gold struct<items:array<{ITEM}>>")).count() == 0
