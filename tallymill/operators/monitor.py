"""Latency, throughput and token statistics of runs, and group reports over traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import beside, percentiles, share


POINTS = {"p50": 0.5, "p95": 0.95}


def run_stats(preds: DataFrame, *by: str) -> DataFrame:
    """Stage percentiles, throughput and tokens of (t_ocr, t_llm, prompt_tokens, completion_tokens, done_reason). Absent stage times are 0 seconds."""
    ocr, llm = F.coalesce("t_ocr", F.lit(0.0)), F.coalesce("t_llm", F.lit(0.0))
    means = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.lit(60.0), F.avg(ocr + llm)).alias("per_minute"),
        F.avg("prompt_tokens").alias("prompt_tokens_mean"),
        F.avg("completion_tokens").alias("completion_tokens_mean"),
        F.count_if(F.col("done_reason") == "length").alias("truncated"),
    )
    times = percentiles(preds, by, {"ocr": ocr, "llm": llm, "total": ocr + llm}, POINTS)
    return beside(means, times, by, "left") if by else means.crossJoin(times)  # one row each


def group_report(traces: DataFrame, by: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Median and 95th percentile of each measure by group; rows with a null key do not count."""
    for k in by:
        traces = traces.filter(F.col(k).isNotNull())
    counts = traces.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return beside(counts, percentiles(traces, by, {m: F.col(m) for m in measures}, POINTS), by)


def mean_tokens(traces: DataFrame, by: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Group means, rounded half-even to whole numbers."""
    for k in by:
        traces = traces.filter(F.col(k).isNotNull())
    return traces.groupBy(*by).agg(*[F.bround(F.avg(m), 0).alias(m) for m in measures])


def headline(traces: DataFrame) -> DataFrame:
    """Median, 95th percentile and share of approvals over all traces."""
    counts = traces.agg(F.count(F.lit(1)).alias("n"), (100.0 * share(F.col("decision") == "auto_approve")).alias("auto_approve_pct"))
    times = percentiles(traces, (), {"t": F.col("t_total")}, POINTS).select(F.col("t_p50").alias("p50"), F.col("t_p95").alias("p95"))
    return counts.crossJoin(times).select("n", "p50", "p95", "auto_approve_pct")  # one row each


def latest(traces: DataFrame, n: int = 50, source: str | None = None) -> DataFrame:
    """The newest n traces, of one source or of all: by time where they have one, then by id."""
    rows = traces if source in (None, "all") else traces.filter(F.col("source") == source)
    return rows.orderBy(*[F.desc(c) for c in ("ts", "id") if c in rows.columns]).limit(n)


#: Size parameter of the kept sketches, and the rank error that they then have with 99 % probability, however many are merged.
SKETCH_SIZE, RANK_ERROR = 400, 0.0074


def sketches(traces: DataFrame, by: tuple[str, ...], measures: tuple[str, ...], time: str = "ts", every: str = "1 hour") -> DataFrame:
    """(start, by, n, a sketch of each measure) of each window: a few kilobytes in place of its rows. They are kept, and added to, window by window."""
    window = F.window(F.col(time), every)["start"].alias("start")
    return traces.groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(SKETCH_SIZE)).alias(m) for m in measures])


def merged_percentiles(kept: DataFrame, by: tuple[str, ...], measures: tuple[str, ...], points: dict[str, float] = POINTS) -> DataFrame:
    """(by, n, measure_point...) over the windows of ``kept``; each has a rank within RANK_ERROR of the point's."""
    merged = kept.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(m)).alias(m) for m in measures])
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)).alias(f"{m}_{p}") for m in measures for p, q in points.items()])


def errors_only(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("exact_match"))


def look_up(rows: DataFrame, id: object, key: str = "id") -> DataFrame:
    """The row of one id, at most one."""
    return rows.filter(F.col(key) == id).limit(1)


def systems_named(rows: DataFrame, prefix: str, system: str = "system") -> DataFrame:
    return rows.filter(F.col(system).startswith(prefix))
