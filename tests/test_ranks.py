"""Distributed ranks and running sums against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators.ranks import with_rank, with_running


def rows(n, seed):
    r = random.Random(seed)
    # group "a" holds most rows, some groups one, one is null
    group = lambda: r.choice(["a"] * 20 + ["b", None, f"g{r.randrange(40)}"])
    return [(i, group(), r.choice([None, r.randrange(30)]), r.choice([None, r.randrange(-5, 9)])) for i in range(n)]


def by_hand(data, grouped):
    seen, out = {}, {}
    for i, g, k, v in sorted(data, key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
        key = g if grouped else 0
        n, s = seen.get(key, (0, 0))
        seen[key] = out[i] = (n + 1, s + (v or 0))
    return out


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("n", [0, 1, 700])
def test_running(spark, by, n):
    data = rows(n, n)
    df = spark.createDataFrame(data, "i int, g string, k int, v int")
    order = [F.col("k"), F.col("i")]
    found = with_running(df, by, order, {"n": F.lit(1), "s": F.col("v")})
    assert found.columns == ["i", "g", "k", "v", "n", "s"]
    assert {r["i"]: (r["n"], r["s"]) for r in found.collect()} == by_hand(data, bool(by))
    ranked = with_rank(df, by, order)
    assert {r["i"]: r["rank"] for r in ranked.collect()} == {i: x[0] for i, x in by_hand(data, bool(by)).items()}


def test_no_single_partition(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    for found in (with_rank(df, (), [F.col("k")]), with_running(df, (), [F.col("k")], {"s": F.col("id")})):
        assert "SinglePartition" not in found._jdf.queryExecution().toString()


def test_ties_get_places_of_their_own(spark):
    df = spark.range(500).select(F.lit(1).alias("k"))
    assert sorted(r["rank"] for r in with_rank(df, (), [F.col("k")]).collect()) == list(range(1, 501))
