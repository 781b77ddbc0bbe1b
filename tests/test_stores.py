"""Prediction store, compacted log, kept scores, error budget, merged sketches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallymill.config import load
from tallymill.operators import compaction, incremental, monitor, review, score
from tallymill.plans import receipts
from tallymill.sources import predictions
from tallymill.types import REVIEW_EVENT

SF = "/root/testdata/sf0.001"


def test_prediction_store_prunes_and_replaces(spark, tmp_path):
    path = str(tmp_path / "store")
    assert predictions.read_store(spark, path, "id long").count() == 0
    rows = spark.range(300).select("id", F.lit("test").alias("split"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("system"), F.lit("m/1").alias("model"), (F.col("id") % 2).cast("string").alias("prompt"))
    predictions.write_runs(rows, path)
    predictions.write_runs(rows.filter("system = 'a' AND id < 30"), path)
    stored = predictions.read_store(spark, path, "id long")
    assert {(r.system, r.prompt): r.n for r in stored.groupBy("system", "prompt").agg(F.count("*").alias("n")).collect()} == {("a", "0"): 5, ("a", "1"): 5, ("b", "0"): 50, ("b", "1"): 50, (None, "0"): 50, (None, "1"): 50}
    wanted = spark.createDataFrame([("test", None, "m/1", "1"), ("test", "a", "m/1", "0")], "split string, system string, model string, prompt string")
    found = predictions.of_runs(stored, wanted)
    assert found.count() == 55 and "dynamicpruning" in found._jdf.queryExecution().toString()


def event(r, i, kind):
    return (f"r{r}", i, float(i), kind, None, None, None, None, None, None, f"c{i}", "pending" if kind == "added" else random.choice(["approved", "rejected"]))


def test_state_equals_a_replay_after_any_compactions(spark, tmp_path):
    random.seed(4)
    log, events = compaction.EventLog(spark, str(tmp_path / "log")), []
    assert log.state().count() == 0 and not log.compact()
    numbers = random.sample(range(1000), 240)  # late events come after later ones were compacted
    for turn in range(4):
        new = [event(random.randrange(12), i, random.choice(["added", "resolved"])) for i in numbers[turn * 60 : turn * 60 + 60]]
        events += new
        log.append(spark.createDataFrame(new, REVIEW_EVENT).repartition(3))
        if turn != 1:
            assert log.compact() and not log.compact()
        if turn == 2:
            assert log.vacuum() > 0 and log.vacuum() == 0
        want = review.state(spark.createDataFrame(events, REVIEW_EVENT))
        assert sorted(map(tuple, log.state().collect())) == sorted(map(tuple, want.select(log.state().columns).collect()))
    assert log.events().count() <= 24


def test_broken_compaction_changes_nothing(spark, tmp_path):
    log = compaction.EventLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([event(1, 1, "added"), event(1, 2, "resolved")], REVIEW_EVENT))
    before = log.state().collect()
    spark.createDataFrame([("x.parquet",)], "name string").write.parquet(str(tmp_path / "log" / "snapshots" / "0" / "covered"))
    assert log.state().collect() == before and log.compact() and log.state().collect() == before


def test_kept_scores_equal_a_recount(spark, tmp_path):
    rows = receipts.predictions(spark, SF).select("system", "id", "pred", "gold", "error")
    path = str(tmp_path / "scored")
    first, n1 = incremental.scored(rows.filter("id % 2 = 0"), path, load())
    n_first = first.count()
    changed = rows.withColumn("pred", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("pred")))
    found, n2 = incremental.scored(changed, path, load())
    again, n3 = incremental.scored(changed, path, load())
    assert n1 == n_first and n3 == 0 and again.count() == found.count() == rows.count()
    assert n2 == changed.count() - rows.filter("id % 2 = 0 AND (id % 10 <> 0 OR pred IS NULL)").count()
    cols = ["system", "id", "item_tp", "exact_match", "decision", "confidence"]
    want = score.evaluate(changed, load())
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize(("most", "passes"), [(0.1, True), (0.0999, False), (0.0, False), (1.0, True)])
def test_error_budget(spark, tmp_path, most, passes):
    rows = spark.range(200).withColumn("error", F.when(F.col("id") % 10 == 3, "bad"))
    path = str(tmp_path / "out")
    if passes:
        assert predictions.write_within_budget(rows, path, F.col("error").isNotNull(), most) == (20, 200)
        assert spark.read.parquet(path).count() == 200
    else:
        with pytest.raises(predictions.ErrorBudgetExceeded, match="20 of 200") as e:
            predictions.write_within_budget(rows, path, F.col("error").isNotNull(), most)
        assert (e.value.failed, e.value.rows) == (20, 200) and not os.path.exists(path)


def test_merged_sketches_keep_their_rank_error(spark):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 2).cast("string").alias("g"), F.pow(F.rand(5), F.lit(3)).alias("t"))
    kept = monitor.sketches(rows, ("g",), ("t",))
    assert kept.count() > 200
    for r in monitor.merged_percentiles(kept, ("g",), ("t",)).collect():
        assert r.n == 30_000
        for p, q in monitor.POINTS.items():
            rank = rows.filter((F.col("g") == r.g) & (F.col("t") <= r[f"t_{p}"])).count() / r.n
            assert abs(rank - q) <= monitor.RANK_ERROR


def test_known_scores_leave_wide_rows_where_they_are(spark):
    rows = incremental.with_digest(receipts.predictions(spark, SF).select("system", "id", "pred", "gold", "error"))
    there = spark.createDataFrame([("rules", 1, 5), ("rules", 1, 6), (None, 2, 7)], "system string, id long, input_digest long")
    plan = incremental.not_among(rows, there).dropDuplicates(list(incremental.KEYS))._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    small = spark.createDataFrame([("rules", 1, 5), ("rules", 1, 8), ("model", 1, 5), (None, 2, 7), ("rules", 3, 5), ("rules", None, 5)], "system string, id long, input_digest long")
    left = incremental.not_among(small, there)
    want = small.join(there, list(incremental.KEYS), "left_anti")
    assert sorted(map(str, left.collect())) == sorted(map(str, want.collect())) and want.count() == 5
