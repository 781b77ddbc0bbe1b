"""Scoring of predictions against gold records, system summaries and the routing trade-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.amounts import money_equal
from ..functions.stats import precision_recall_f1, ratio, share
from ..types import SCORED_FIELDS
from .match import NAME_THRESHOLD, PRICE_TOL, matches
from .ranks import with_running
from .validate import with_settings


def count(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0))


def with_matches(df: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Adds pairs (price and name) and name_pairs; the similarities are computed once."""
    pred, gold = F.col("pred")["items"], F.col("gold")["items"]
    df = df.withColumn("__found", matches(pred, gold, threshold))
    return df.withColumns({k: F.col("__found")[k] for k in ("pairs", "name_pairs")}).drop("__found")


def with_scores(df: DataFrame) -> DataFrame:
    """Scores of rows (pred, gold, pairs, name_pairs). An absent prediction counts as an empty record."""
    pred, gold = F.col("pred"), F.col("gold")
    cols = {}
    for f in SCORED_FIELDS:
        p, g = pred[f], gold[f]
        ok = money_equal(p, g, PRICE_TOL)
        cols |= {f"{f}_correct": ok, f"{f}_tp": (g.isNotNull() & ok).cast("int"), f"{f}_fp": (p.isNotNull() & ~ok).cast("int"), f"{f}_fn": (g.isNotNull() & ~ok).cast("int")}
    n_pred, n_gold, tp = F.coalesce(count(pred["items"]), F.lit(0)), count(gold["items"]), F.size("pairs")
    quantity = F.filter("pairs", lambda x: F.get(gold["items"], x["j"])["quantity"].isNotNull())
    right = F.filter(quantity, lambda x: F.abs(F.get(pred["items"], x["i"])["quantity"] - F.get(gold["items"], x["j"])["quantity"]) < 1e-6)
    cols |= {
        "n_pred_items": n_pred,
        "n_gold_items": n_gold,
        "item_tp": tp,
        "item_fp": n_pred - tp,
        "item_fn": n_gold - tp,
        "item_name_tp": F.size("name_pairs"),
        "item_count_correct": n_pred == n_gold,
        "qty_checked": F.size(quantity),
        "qty_correct": F.size(right),
        "items_exact": (n_pred == tp) & (n_gold == tp),
    }
    df = df.withColumns(cols)
    every = F.col("items_exact")
    for f in SCORED_FIELDS:
        every = every & F.col(f"{f}_correct")
    return df.withColumn("exact_match", every)


def evaluate(df: DataFrame, settings: Settings) -> DataFrame:
    """Validation, matching and scores of rows (pred, gold, error) by ``settings``."""
    return with_scores(with_matches(with_settings(df, settings, "pred", "error"), settings.item_name_threshold))


def summarise(scores: DataFrame, *by: str) -> DataFrame:
    """One metrics row for each group; no rows, no metrics."""
    sums = lambda c: F.sum(c)
    aggs = [F.count(F.lit(1)).alias("n"), share(F.col("schema_valid")).alias("schema_valid_rate")]
    for f in SCORED_FIELDS:
        aggs += [share(F.col(f"{f}_correct")).alias(f"{f}_acc"), precision_recall_f1(sums(f"{f}_tp"), sums(f"{f}_fp"), sums(f"{f}_fn"))[2].alias(f"{f}_f1")]
    p, r, f1 = precision_recall_f1(sums("item_tp"), sums("item_fp"), sums("item_fn"))
    named = sums("item_name_tp")
    aggs += [
        p.alias("item_p"),
        r.alias("item_r"),
        f1.alias("item_f1"),
        precision_recall_f1(named, sums("n_pred_items") - named, sums("n_gold_items") - named)[2].alias("item_name_f1"),
        share(F.col("item_count_correct")).alias("item_count_acc"),
        ratio(sums("qty_correct"), sums("qty_checked")).alias("qty_acc_matched"),
        share(F.col("exact_match")).alias("exact_match_rate"),
    ]
    return scores.groupBy(*by).agg(*aggs)


def summarise_runs(scores: DataFrame, runs: DataFrame, by: str = "system") -> DataFrame:
    """One metrics row for each of ``runs``; one without any score has n = 0 and no metrics."""
    found = runs.select(by).distinct().join(summarise(scores, by), by, "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def routing_stats(scores: DataFrame, *by: str) -> DataFrame:
    """What routing lets pass and what it catches; null where a side is empty."""
    approved, wrong = F.col("decision") == "auto_approve", ~F.col("exact_match")
    return scores.groupBy(*by).agg(
        share(approved).alias("auto_approve_rate"),
        share(F.col("exact_match"), approved).alias("approved_exact"),
        share(F.col("exact_match"), ~approved).alias("review_exact"),
        share(F.col("total_correct"), approved).alias("approved_total_acc"),
        share(F.col("total_correct"), ~approved).alias("review_total_acc"),
        (F.count_if(wrong & ~approved) / F.greatest(F.lit(1), F.count_if(wrong))).alias("errors_caught"),
    )


def routing_curve(scores: DataFrame, *by: str) -> DataFrame:
    """For each distinct confidence, and 0: what approving everything from there on would give.

    Rows are first summed by confidence. Confidences may be continuous, so that there are nearly as many sums as rows: their running
    sums are distributed.
    """
    steps = scores.groupBy(*by, F.col("confidence").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("exact_match")).alias("exact"), F.count_if(F.col("total_correct")).alias("total")
    )
    sums = ("n", "exact", "total")
    so_far = with_running(steps, by, [F.desc("threshold")], {f"{c}_so_far": F.col(c) for c in sums})
    known = F.col("threshold").isNotNull()
    every = so_far.groupBy(*by).agg(F.sum("n").alias("every"), F.max(F.coalesce(F.col("threshold") == 0, F.lit(False))).alias("has_0"), *[F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(f"{c}_so_far") for c in sums])
    counts = every.select(*by, "every")
    whole = so_far.join(F.broadcast(counts), list(by)) if by else so_far.crossJoin(counts)  # one row for each system
    floor = every.filter("NOT has_0").withColumn("threshold", F.lit(0.0))
    cols = [*by, "threshold", "every", *[f"{c}_so_far" for c in sums]]
    whole = whole.select(*cols).unionByName(floor.select(*cols))
    n, exact, total = (F.col(f"{c}_so_far") for c in sums)
    return whole.select(
        *by,
        "threshold",
        ratio(n, F.col("every")).alias("approve_rate"),
        ratio(exact, n).alias("approved_exact"),
        ratio(total, n).alias("approved_total_acc"),
    )
