"""Registered queries of the engine's own operators, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load
from ..functions import amounts as A
from ..functions import names as N
from ..functions import unicode as U
from ..functions.stats import precision_recall_f1, share
from ..operators import compaction, errors, extract, incremental, ingest, layout, match, monitor, ranks, review, score, sets, validate
from ..sources import predictions
from ..sources.files import read_table
from ..store import folder, keep
from ..types import SCORED_FIELDS
from . import receipts as R

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- SQL building blocks

LINES = """
li AS (SELECT l_orderkey AS k, p_name AS name, l_quantity AS qty, CAST(floor(l_extendedprice * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS cents,
              l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
ln AS (SELECT *, CAST(floor(cents / qty + CAST(0.5 AS DOUBLE)) AS BIGINT) AS unit,
              row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, cents, qty) - 1 AS j FROM li),
sums AS (SELECT k, CAST(sum(cents) AS BIGINT) AS sub, CAST(count(*) AS BIGINT) AS n FROM ln GROUP BY k),
parts AS (SELECT *, CASE WHEN k % 3 = 0 THEN sub // 20 END AS disc, CASE WHEN k % 4 = 0 THEN sub // 20 END AS svc, CASE WHEN k % 5 <> 0 THEN sub // 10 END AS tax FROM sums),
gold AS (SELECT *, sub - coalesce(disc, 0) + coalesce(svc, 0) + coalesce(tax, 0) AS total FROM parts)"""

PRED = (
    LINES
    + """,
sy AS (SELECT * FROM (VALUES ('rules', 0), ('model', 3)) t(system, shift)),
pr AS (SELECT system, k, (k + shift) % 10 AS m, n, sub AS gsub, disc AS gdisc, svc AS gsvc, tax AS gtax, total AS gtotal,
              CASE WHEN (k + shift) % 10 NOT IN (5, 6) THEN sub END AS sub, CASE WHEN (k + shift) % 10 <> 6 THEN disc END AS disc,
              CASE WHEN (k + shift) % 10 <> 6 THEN svc END AS svc, CASE WHEN (k + shift) % 10 NOT IN (2, 6) THEN tax END AS tax,
              CASE (k + shift) % 10 WHEN 1 THEN total + 500 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE total END AS total FROM gold, sy),
pi AS (SELECT system, pr.k, m, CASE WHEN m = 3 THEN j - 1 ELSE j END AS i, CASE WHEN m = 4 THEN reverse(name) ELSE name END AS name, qty, unit,
              CASE WHEN m = 9 AND j = 0 THEN cents * 2 ELSE cents END AS cents
       FROM pr JOIN ln ON pr.k = ln.k WHERE m <> 6 AND NOT (m = 3 AND j = 0)
       UNION ALL SELECT system, k, m, n, 'free sample', CAST(1 AS DOUBLE), 50, 50 FROM pr WHERE m = 8),
items AS (SELECT system, k, CAST(sum(cents) AS BIGINT) AS s, count(*) AS n, count(*) FILTER (abs(qty * (unit / CAST(100 AS DOUBLE)) - cents / CAST(100 AS DOUBLE)) > greatest(CAST(1 AS DOUBLE), CAST(0.005 AS DOUBLE) * greatest(abs(qty * (unit / CAST(100 AS DOUBLE))), abs(cents / CAST(100 AS DOUBLE))))) AS bad
          FROM pi GROUP BY system, k),
amt AS (SELECT pr.*, coalesce(items.n, 0) AS n_items, s, bad, coalesce(tax, 0) AS tax0, coalesce(svc, 0) AS svc0, coalesce(disc, 0) AS disc0 FROM pr LEFT JOIN items USING (system, k)),
near AS (SELECT *, abs(s - sub) <= greatest(100, 0.005 * greatest(abs(s), abs(sub))) AS net, tax0 <> 0 AND abs(s - sub - tax0) <= greatest(100, 0.005 * greatest(abs(s), abs(sub + tax0))) AS gross,
              abs(s - total) <= greatest(100, 0.005 * greatest(abs(s), abs(total))) OR abs(s - total + tax0 + svc0 - disc0) <= greatest(100, 0.005 * greatest(abs(s), abs(total - tax0 - svc0 + disc0)))
                OR abs(s - total + svc0 - disc0) <= greatest(100, 0.005 * greatest(abs(s), abs(total - svc0 + disc0))) AS open_ok,
              abs(sub - disc0 + tax0 + svc0 - total) <= greatest(100, 0.005 * greatest(abs(sub - disc0 + tax0 + svc0), abs(total)))
                OR (tax0 <> 0 AND abs(sub - disc0 + svc0 - total) <= greatest(100, 0.005 * greatest(abs(sub - disc0 + svc0), abs(total)))) AS total_ok FROM amt),
st AS (SELECT *, m <> 6 AS schema_valid, CASE WHEN m = 6 THEN 'fail' ELSE 'pass' END AS rule_schema,
              CASE WHEN m <> 6 THEN CASE WHEN total IS NULL THEN 'fail' ELSE 'pass' END END AS rule_total_present,
              CASE WHEN m <> 6 THEN CASE WHEN n_items = 0 THEN 'fail' ELSE 'pass' END END AS rule_items_present,
              CASE WHEN m <> 6 THEN CASE WHEN n_items = 0 THEN 'skip' WHEN sub IS NOT NULL THEN CASE WHEN net OR gross THEN 'pass' ELSE 'fail' END
                   WHEN total IS NOT NULL THEN CASE WHEN open_ok THEN 'pass' ELSE 'fail' END ELSE 'skip' END END AS rule_items_sum,
              CASE WHEN m <> 6 THEN CASE WHEN sub IS NULL OR total IS NULL THEN 'skip' WHEN total_ok THEN 'pass' ELSE 'fail' END END AS rule_total_check,
              CASE WHEN m <> 6 THEN CASE WHEN n_items = 0 THEN 'skip' WHEN bad > 0 THEN 'fail' ELSE 'pass' END END AS rule_line_math FROM near),
cf AS (SELECT *, CASE WHEN m = 6 THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(0, 100 - CASE rule_total_present WHEN 'fail' THEN 50 ELSE 0 END - CASE rule_items_present WHEN 'fail' THEN 30 ELSE 0 END
              - CASE rule_items_sum WHEN 'fail' THEN 40 WHEN 'skip' THEN 15 ELSE 0 END - CASE WHEN rule_total_check = 'fail' THEN 40 WHEN rule_total_check = 'skip' AND rule_items_sum <> 'pass' THEN 5 ELSE 0 END
              - CASE rule_line_math WHEN 'fail' THEN 20 ELSE 0 END) AS DOUBLE) / 100 END AS confidence FROM st),
va AS (SELECT *, CASE WHEN confidence >= 1 AND 'fail' NOT IN (rule_schema, rule_total_present, rule_items_present, rule_items_sum, rule_total_check, rule_line_math) THEN 'auto_approve' ELSE 'review' END AS decision FROM cf)"""
)

#: Similarity of names by LCS, over the distinct pairs of names that occur.
SIMS = """
nm AS (SELECT DISTINCT name, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS nn FROM (SELECT p_name AS name FROM part UNION SELECT reverse(p_name) FROM part UNION SELECT 'free sample')),
sm AS (SELECT a.name AS pa, b.name AS gb, CASE WHEN a.nn = b.nn THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * list_reduce(string_split(a.nn, ''),
         lambda acc, x: list_reduce(string_split(b.nn, ''), lambda r, y: list_append(r, CASE WHEN x = y THEN acc[len(r)] + 1 ELSE greatest(acc[len(r) + 1], r[len(r)]) END), [0]),
         list_transform(range(len(b.nn) + 1), lambda z: 0))[-1] / (len(a.nn) + len(b.nn)) END AS sim FROM nm a, nm b)"""

MATCH = (
    PRED
    + ","
    + SIMS
    + """,
ca AS (SELECT pi.system, pi.k, pi.i, ln.j, sim, abs(pi.cents - ln.cents) <= 50 AS priced, pi.qty AS pq, ln.qty AS gq FROM pi JOIN ln ON pi.k = ln.k JOIN sm ON sm.pa = pi.name AND sm.gb = ln.name WHERE sim >= 0.6),
gr AS (SELECT system, k,
         list_reduce(list({'i': i, 'j': j, 'ok': CAST(abs(pq - gq) < 1e-6 AS INT)} ORDER BY sim DESC, i DESC, j DESC) FILTER (priced),
           lambda d, c: CASE WHEN list_contains(d.p, c.i) OR list_contains(d.g, c.j) THEN d ELSE {'p': list_append(d.p, c.i), 'g': list_append(d.g, c.j), 'ok': d.ok + c.ok} END,
           {'p': CAST([] AS BIGINT[]), 'g': CAST([] AS BIGINT[]), 'ok': 0}) AS price,
         list_reduce(list({'i': i, 'j': j} ORDER BY sim DESC, i DESC, j DESC),
           lambda d, c: CASE WHEN list_contains(d.p, c.i) OR list_contains(d.g, c.j) THEN d ELSE {'p': list_append(d.p, c.i), 'g': list_append(d.g, c.j)} END,
           {'p': CAST([] AS BIGINT[]), 'g': CAST([] AS BIGINT[])}) AS named FROM ca GROUP BY system, k),
mt AS (SELECT va.*, coalesce(len(price.p), 0) AS tp, coalesce(len(named.p), 0) AS ntp, coalesce(price.ok, 0) AS qok FROM va LEFT JOIN gr USING (system, k)),
sc AS (SELECT *, (total IS NOT DISTINCT FROM gtotal) OR coalesce(abs(total - gtotal) <= 50, false) AS total_correct, sub IS NOT DISTINCT FROM gsub AS subtotal_correct,
              tax IS NOT DISTINCT FROM gtax AS tax_correct, svc IS NOT DISTINCT FROM gsvc AS service_charge_correct FROM mt),
ex AS (SELECT *, total_correct AND subtotal_correct AND tax_correct AND service_charge_correct AND tp = n_items AND tp = n AS exact_match FROM sc)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.evaluate(R.predictions(spark, sf_dir), load())


def rounded(df: DataFrame, *keep: str, places: int = 9) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, places).alias(c) for c in df.columns])


# ---------------------------------------------------------------- validation and routing


@query(f"WITH {PRED} SELECT system, k AS id, schema_valid, rule_schema, rule_total_present, rule_items_present, rule_items_sum, rule_total_check, rule_line_math, confidence, decision FROM va")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_validation(R.predictions(spark, sf_dir), "pred", "error")
    return rows.select("system", "id", "schema_valid", *[f"rule_{n}" for n in validate.RULES], "confidence", "decision")


@query(
    f"""WITH {PRED}, long AS (UNPIVOT (SELECT system, rule_schema AS schema, rule_total_present AS total_present, rule_items_present AS items_present, rule_items_sum AS items_sum, rule_total_check AS total_check, rule_line_math AS line_math FROM va)
ON schema, total_present, items_present, items_sum, total_check, line_math INTO NAME rule VALUE status) SELECT system, rule, status, count(*) AS n FROM long GROUP BY ALL"""
)
def rule_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rule_counts(validate.with_validation(R.predictions(spark, sf_dir), "pred", "error"), "system")


@query(
    f"""WITH {PRED}, rs AS (SELECT system, k AS id, CASE WHEN m = 6 THEN 'schema invalid' ELSE concat_ws(', ', CASE WHEN rule_total_present = 'fail' THEN 'total_present failed' END, CASE WHEN rule_items_present = 'fail' THEN 'items_present failed' END,
CASE WHEN rule_items_sum = 'fail' THEN 'items_sum failed' END, CASE WHEN rule_total_check = 'fail' THEN 'total_check failed' END, CASE WHEN rule_line_math = 'fail' THEN 'line_math failed' END) END AS reasons,
CASE WHEN m <> 6 THEN CASE WHEN n_items = 0 THEN 'no item has qty, unit price and line total' WHEN bad > 0 THEN bad || '/' || n_items || ' items fail' ELSE n_items || ' items checked' END END AS line_detail,
CASE WHEN m <> 6 THEN CASE WHEN sub IS NULL OR total IS NULL THEN 'needs subtotal and total' WHEN abs(sub - disc0 + tax0 + svc0 - total) <= greatest(100, 0.005 * greatest(abs(sub - disc0 + tax0 + svc0), abs(total))) THEN format('{{:,.2f}}', (sub - disc0 + tax0 + svc0) / CAST(100 AS DOUBLE)) || ' == total'
  WHEN total_ok THEN 'tax included in prices' ELSE 'subtotal-disc+tax+svc = ' || format('{{:,.2f}}', (sub - disc0 + tax0 + svc0) / CAST(100 AS DOUBLE)) || ' vs total ' || format('{{:,.2f}}', total / CAST(100 AS DOUBLE)) END END AS total_detail FROM va)
SELECT * FROM rs"""
)
def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of a review, and the details of two rules (without the names of failing items)."""
    rows = validate.with_validation(R.predictions(spark, sf_dir), "pred", "error")
    detail = lambda name: F.get(F.filter("rules", lambda x: x["name"] == name), F.lit(0))["detail"]
    return rows.select("system", "id", F.array_join("reasons", ", ").alias("reasons"), F.regexp_replace(detail("line_math"), ": .*", "").alias("line_detail"), detail("total_check").alias("total_detail"))


@query(f"WITH {MATCH} SELECT system, k AS id, exact_match FROM ex WHERE NOT exact_match AND starts_with(system, 'mod')")
def wrong_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the systems with one prefix that are not exactly right."""
    return monitor.errors_only(monitor.systems_named(scored(spark, sf_dir), "mod")).select("system", "id", "exact_match")


@query(f"WITH {PRED} SELECT system, confidence, count(*) AS n FROM va GROUP BY ALL")
def confidence_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_validation(R.predictions(spark, sf_dir), "pred", "error")
    return rows.groupBy("system", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PRED}, ok AS (SELECT *, 'fail' NOT IN (rule_schema, rule_total_present, rule_items_present, rule_items_sum, rule_total_check, rule_line_math) AS clean FROM va)
SELECT system, {", ".join(f"count(*) FILTER (clean AND confidence >= greatest(1.0, {t})) AS {name}" for t, name in ((0.0, "at_0"), (1.0, "at_1"), (1.01, "above_1")))} FROM ok GROUP BY system"""
)
def threshold_inert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 1 the threshold changes no decision; above 1 nothing is approved."""
    rows = validate.with_validation(R.predictions(spark, sf_dir), "pred", "error")
    return rows.groupBy("system").agg(*[F.count_if(validate.approved(t)).alias(name) for t, name in ((0.0, "at_0"), (1.0, "at_1"), (1.01, "above_1"))])


@query(
    f"""WITH {MATCH} SELECT system, round(avg(CAST(decision = 'auto_approve' AS INT)), 9) AS auto_approve_rate, round(avg(CAST(exact_match AS INT)) FILTER (decision = 'auto_approve'), 9) AS approved_exact,
round(avg(CAST(exact_match AS INT)) FILTER (decision <> 'auto_approve'), 9) AS review_exact, round(avg(CAST(total_correct AS INT)) FILTER (decision = 'auto_approve'), 9) AS approved_total_acc,
round(avg(CAST(total_correct AS INT)) FILTER (decision <> 'auto_approve'), 9) AS review_total_acc, round(count(*) FILTER (NOT exact_match AND decision <> 'auto_approve') / CAST(greatest(1, count(*) FILTER (NOT exact_match)) AS DOUBLE), 9) AS errors_caught FROM ex GROUP BY system"""
)
def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.routing_stats(scored(spark, sf_dir), "system"), "system")


@query(
    f"""WITH {MATCH}, th AS (SELECT DISTINCT system, confidence AS threshold FROM ex UNION SELECT DISTINCT system, CAST(0 AS DOUBLE) FROM ex)
SELECT th.system, threshold, round(count(*) FILTER (confidence >= threshold) / CAST(count(*) AS DOUBLE), 9) AS approve_rate, round(avg(CAST(exact_match AS INT)) FILTER (confidence >= threshold), 9) AS approved_exact,
round(avg(CAST(total_correct AS INT)) FILTER (confidence >= threshold), 9) AS approved_total_acc FROM th JOIN ex ON th.system = ex.system GROUP BY th.system, threshold"""
)
def routing_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.routing_curve(scored(spark, sf_dir), "system"), "system", "threshold")


@query(
    """WITH d AS (SELECT l_suppkey % 3 AS system, l_extendedprice AS threshold, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS exact, count(*) FILTER (l_linestatus = 'O') AS total FROM lineitem GROUP BY ALL
UNION ALL SELECT DISTINCT l_suppkey % 3, CAST(0 AS DOUBLE), 0, 0, 0 FROM lineitem),
r AS (SELECT system, threshold, sum(n) OVER w AS n, sum(exact) OVER w AS exact, sum(total) OVER w AS total, sum(n) OVER (PARTITION BY system) AS every FROM d WINDOW w AS (PARTITION BY system ORDER BY threshold DESC))
SELECT system, threshold, round(n / CAST(every AS DOUBLE), 9) AS approve_rate, round(exact / CAST(n AS DOUBLE), 9) AS approved_exact, round(total / CAST(n AS DOUBLE), 9) AS approved_total_acc FROM r"""
)
def routing_curve_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade-off over confidences that hardly repeat: the price of an order line stands for one, its flags for correctness."""
    li = read_table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_suppkey") % 3).alias("system"), F.col("l_extendedprice").alias("confidence"), (F.col("l_returnflag") == "N").alias("exact_match"), (F.col("l_linestatus") == "O").alias("total_correct"))
    return rounded(score.routing_curve(rows, "system"), "system", "threshold")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS so_far FROM events")
def event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and running sum of every event in the few groups that the table has."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    order = [F.desc("value"), F.col("event_id")]
    return ranks.with_running(e, ("event_type",), order, {"place": F.lit(1), "so_far": F.col("user_id")}).select("event_id", "place", "so_far")


# ---------------------------------------------------------------- scoring


def _flags(f: str, p: str, g: str) -> str:
    return f"{f}_correct, CAST({g} IS NOT NULL AND {f}_correct AS INT) AS {f}_tp, CAST({p} IS NOT NULL AND NOT {f}_correct AS INT) AS {f}_fp, CAST({g} IS NOT NULL AND NOT {f}_correct AS INT) AS {f}_fn"


FLAGS = ", ".join(_flags(f, p, g) for f, p, g in (("total", "total", "gtotal"), ("subtotal", "sub", "gsub"), ("tax", "tax", "gtax"), ("service_charge", "svc", "gsvc")))


@query(f"WITH {MATCH} SELECT system, k AS id, {FLAGS} FROM ex")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("system", "id", *[f"{f}_{x}" for f in SCORED_FIELDS for x in ("correct", "tp", "fp", "fn")])


@query(f"WITH {MATCH} SELECT system, k AS id, CAST(n_items AS INT) AS n_pred_items, CAST(n AS INT) AS n_gold_items, CAST(tp AS INT) AS item_tp, CAST(ntp AS INT) AS item_name_tp, CAST(tp AS INT) AS qty_checked, CAST(qok AS INT) AS qty_correct, exact_match FROM ex")
def item_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("system", "id", "n_pred_items", "n_gold_items", "item_tp", "item_name_tp", "qty_checked", "qty_correct", "exact_match")


@query(f"WITH {MATCH} SELECT system, k AS id, CAST(tp AS INT) AS item_tp, exact_match, k % 4 = 0 AS was_new FROM ex")
def scored_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a kept table: three of four records were scored by an earlier job; the second finds them and scores the rest."""
    rows, path = R.predictions(spark, sf_dir), folder(spark, "scored")
    incremental.scored(rows.filter(F.col("id") % 4 != 0), path, load())
    early = keep(spark.read.parquet(path).select("system", "id"), "early")
    found, _ = incremental.scored(rows, path, load())
    was_new = early.withColumn("early", F.lit(True))
    return found.join(was_new, ["system", "id"], "left").select("system", "id", "item_tp", "exact_match", F.col("early").isNull().alias("was_new"))


@query(f"""WITH {PRED} SELECT 'test' AS split, system, CASE WHEN system = 'model' THEN 'm' || (k % 3) END AS model, 'v' || (k % 2) AS prompt, count(*) AS n, count(*) FILTER (NOT schema_valid) AS failed FROM va WHERE k % 2 = 1 AND (system = 'rules' OR k % 3 = 0) GROUP BY ALL""")
def predictions_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failures of some runs of a store that is partitioned by run; the table of runs prunes the store's partitions when the query runs."""
    rows, path = R.predictions(spark, sf_dir).select("system", "id", "error"), folder(spark, "predictions")
    rows = rows.withColumns({"split": F.lit("test"), "model": F.when(F.col("system") == "model", F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))), "prompt": F.concat(F.lit("v"), (F.col("id") % 2).cast("string"))})
    predictions.write_runs(rows, path)
    predictions.write_runs(rows.filter("prompt = 'v1'"), path)  # runs that come again are replaced
    wanted = spark.createDataFrame([("test", "rules", None, "v1"), ("test", "model", "m0", "v1"), ("test", "none", None, "v1")], "split string, system string, model string, prompt string")
    stored = predictions.of_runs(predictions.read_store(spark, path, "id long, error string"), wanted)
    return stored.groupBy(*predictions.RUN).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"))


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN 2 * ({tp}) + ({fp}) + ({fn}) = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * ({tp}) / CAST(2 * ({tp}) + ({fp}) + ({fn}) AS DOUBLE) END"


@query(
    f"""WITH {MATCH}, fl AS (SELECT *, {FLAGS.replace("total_correct, ", "", 1).replace("subtotal_correct, ", "", 1).replace("tax_correct, ", "", 1).replace("service_charge_correct, ", "", 1)} FROM ex)
SELECT system, count(*) AS n, round(avg(CAST(schema_valid AS INT)), 9) AS schema_valid_rate, {", ".join(f"round(avg(CAST({f}_correct AS INT)), 9) AS {f}_acc, round({_f1(f'sum({f}_tp)', f'sum({f}_fp)', f'sum({f}_fn)')}, 9) AS {f}_f1" for f in SCORED_FIELDS)},
round(sum(tp) / CAST(sum(n_items) AS DOUBLE), 9) AS item_p, round(sum(tp) / CAST(sum(n) AS DOUBLE), 9) AS item_r, round({_f1("sum(tp)", "sum(n_items) - sum(tp)", "sum(n) - sum(tp)")}, 9) AS item_f1, round({_f1("sum(ntp)", "sum(n_items) - sum(ntp)", "sum(n) - sum(ntp)")}, 9) AS item_name_f1,
round(avg(CAST(n_items = n AS INT)), 9) AS item_count_acc, round(sum(qok) / CAST(sum(tp) AS DOUBLE), 9) AS qty_acc_matched, round(avg(CAST(exact_match AS INT)), 9) AS exact_match_rate FROM fl GROUP BY system"""
)
def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.summarise(scored(spark, sf_dir), "system"), "system", "n")


@query(f"SELECT * FROM ({ORACLES['system_metrics']}) UNION ALL BY NAME SELECT 'vision' AS system, 0 AS n")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all runs, one of which has no results."""
    runs = spark.createDataFrame([(x,) for x in (*R.SYSTEMS, "vision")], "system string")
    return rounded(score.summarise_runs(scored(spark, sf_dir), runs), "system", "n")


@query(
    f"""WITH {PRED}, {SIMS},
gl AS (SELECT k, count(*) AS n_lines, count(*) FILTER (abs(qty * (unit / CAST(100 AS DOUBLE)) - cents / CAST(100 AS DOUBLE)) > 1) AS bad FROM ln GROUP BY k),
own AS (SELECT a.k, a.j AS i, b.j, sim FROM ln a JOIN ln b ON a.k = b.k JOIN sm ON sm.pa = a.name AND sm.gb = b.name WHERE sim >= 0.6 AND abs(a.cents - b.cents) <= 50),
met AS (SELECT k, list_reduce(list({{'i': i, 'j': j}} ORDER BY sim DESC, i DESC, j DESC),
  lambda d, c: CASE WHEN list_contains(d.p, c.i) OR list_contains(d.g, c.j) THEN d ELSE {{'p': list_append(d.p, c.i), 'g': list_append(d.g, c.j)}} END, {{'p': CAST([] AS BIGINT[]), 'g': CAST([] AS BIGINT[])}}) AS pairs FROM own GROUP BY k)
SELECT 'gold' AS system, count(*) AS n, round(avg(CAST(bad = 0 AS INT)), 9) AS auto_approve_rate, round(avg(CAST(coalesce(len(pairs.p), 0) = n_lines AS INT)), 9) AS exact_match_rate FROM gl JOIN gold USING (k) LEFT JOIN met USING (k)"""
)
def ceiling_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records as their own predictions: the best any system can reach."""
    gold = R.gold_records(spark, sf_dir).withColumns({"pred": F.col("gold"), "error": F.lit(None).cast("string")})
    s = score.with_scores(score.with_matches(validate.with_validation(gold, "pred", "error")))
    return s.agg(F.lit("gold").alias("system"), F.count(F.lit(1)).alias("n"), F.round(share(F.col("decision") == "auto_approve"), 9).alias("auto_approve_rate"), F.round(share(F.col("exact_match")), 9).alias("exact_match_rate")).select("system", "n", "auto_approve_rate", "exact_match_rate")


@query(
    """SELECT round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1, round(tp / CAST(tp + fp AS DOUBLE), 9) AS p, round(tp / CAST(tp + fn AS DOUBLE), 9) AS r FROM
(SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fn FROM labels)"""
)
def labels_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality as a prediction of toxicity."""
    t, q = F.col("toxic") == 1, F.col("quality") == 0
    sums = read_table(spark, sf_dir, "labels").agg(F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"))
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(F.round(f1, 9).alias("f1"), F.round(p, 9).alias("p"), F.round(r, 9).alias("r"))


@query(f"WITH {SIMS} SELECT DISTINCT a.p_name AS a, b.p_name AS b, round(sim, 9) AS sim FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b JOIN sm ON true WHERE sm.pa = a.p_name AND sm.gb = b.p_name AND a.p_name < b.p_name AND sim >= 0.6")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs among the distinct part names."""
    pairs = match.similar_names(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 0.6)
    return pairs.withColumn("sim", F.round("sim", 9))


# ---------------------------------------------------------------- joins and sets


@query()
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word of ten letters and more that the documents have: how many others are at least 0.9 alike, and the most alike of them (ties: the
    first). SQL has no such similarity at this size."""
    text = read_table(spark, sf_dir, "documents").select(F.explode(F.split(F.upper("text"), "[^A-Z]+")).alias("name"))
    pairs = match.similar_names(text.filter(F.length("name") >= 10), 0.9)
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "sim"), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "sim"))))
    return ends.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min_by("other", F.struct(-F.col("sim"), F.col("other"))).alias("nearest"), F.round(F.max("sim"), 9).alias("sim"))


@query(f"WITH {PRED}, rn AS (SELECT 'rules' AS system, k FROM gold UNION ALL SELECT 'model', k FROM gold WHERE k % 7 <> 0 UNION ALL SELECT 'vision', k FROM gold WHERE k % 3 = 0) SELECT k AS id FROM gold WHERE k % 7 <> 0 AND k % 3 = 0")
def subset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that all partial runs cover."""
    gold = R.lines_of(spark, sf_dir).select(F.col("k").alias("id")).distinct()
    return sets.common_subset(partial_runs(gold), gold.count())


def partial_runs(gold: DataFrame) -> DataFrame:
    some = lambda name, keep: gold.filter(keep).select(F.lit(name).alias("system"), "id")
    return some("rules", F.lit(True)).unionByName(some("model", F.col("id") % 7 != 0)).unionByName(some("vision", F.col("id") % 3 == 0))


RUNS = "rn AS (SELECT 'rules' AS system, k FROM gold UNION ALL SELECT 'model', k FROM gold WHERE k % 7 <> 0 UNION ALL SELECT 'vision', k FROM gold WHERE k % 3 = 0)"


@query(f"WITH {LINES}, {RUNS}, ids AS (SELECT k FROM gold WHERE k % 3 = 0) SELECT system FROM rn JOIN ids USING (k) GROUP BY system HAVING count(*) = (SELECT count(*) FROM ids)")
def subset_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that cover every third id."""
    gold = R.lines_of(spark, sf_dir).select(F.col("k").alias("id")).distinct()
    return sets.covering(partial_runs(gold), gold.filter("id % 3 = 0"))


@query(
    f"""WITH {MATCH}, cov AS (SELECT * FROM ex WHERE system = 'rules' OR k % 7 <> 0),
part AS (SELECT system FROM cov GROUP BY system HAVING count(*) < (SELECT count(*) FROM gold)), ids AS (SELECT k FROM cov JOIN part USING (system) GROUP BY k HAVING count(*) = (SELECT count(*) FROM part)),
whole AS (SELECT system FROM cov JOIN ids USING (k) GROUP BY system HAVING count(*) = (SELECT count(*) FROM ids))
SELECT system, count(*) AS n, round(avg(CAST(exact_match AS INT)), 9) AS exact_match_rate, round(avg(CAST(total_correct AS INT)), 9) AS total_acc, {"round(" + "2 * sum(tp) / CAST(sum(n_items) + sum(n) AS DOUBLE), 9)"} AS item_f1 FROM cov JOIN ids USING (k) JOIN whole USING (system) GROUP BY system"""
)
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs on the records that the partial run (one in seven records is missing) covers."""
    rows = scored(spark, sf_dir).filter((F.col("system") == "rules") | (F.col("id") % 7 != 0))
    whole = R.lines_of(spark, sf_dir).select("k").distinct().count()
    found = score.summarise(sets.on_subset(rows, whole), "system")
    return rounded(found.select("system", "n", "exact_match_rate", "total_acc", "item_f1"), "system", "n")


@query(
    f"""WITH {LINES}, m AS (SELECT *, 'store ' || (k % 50) AS store FROM gold), f AS (SELECT k AS id, 'store_name' AS field, store AS value FROM m UNION ALL SELECT k, 'currency', CASE WHEN k % 2 = 0 THEN 'IDR' ELSE '-' END FROM m
  UNION ALL SELECT k, field, CASE WHEN c IS NULL THEN '-' ELSE regexp_replace(format('{{:,.2f}}', c / CAST(100 AS DOUBLE)), '\\.?0+$', '') END FROM (SELECT k, 'subtotal' AS field, sub AS c FROM m UNION ALL SELECT k, 'discount', disc FROM m UNION ALL SELECT k, 'tax', tax FROM m UNION ALL SELECT k, 'service_charge', svc FROM m UNION ALL SELECT k, 'total', total FROM m)) SELECT * FROM f"""
)
def record_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.record_scalars(R.gold_records(spark, sf_dir), "gold")


@query(f"""WITH {LINES}, sh AS (SELECT * FROM ln) SELECT k AS id, CAST(j AS INT) AS place, name, qty AS quantity, regexp_replace(format('{{:,.2f}}', unit / CAST(100 AS DOUBLE)), '\\.?0+$', '') AS unit_price, regexp_replace(format('{{:,.2f}}', cents / CAST(100 AS DOUBLE)), '\\.?0+$', '') AS line_total FROM sh""")
def record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.record_items(R.gold_records(spark, sf_dir), "gold")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'validation' ELSE o_orderstatus END AS split, count(*) AS n FROM orders GROUP BY 1")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split; finished orders stand for dev, which names the validation split."""
    o = read_table(spark, sf_dir, "orders")
    return sets.manifest(o.select(sets.split_alias(F.when(F.col("o_orderstatus") == "F", "dev").otherwise(F.col("o_orderstatus"))).alias("split")))


@query("SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'test__regex' ELSE 'test__llm__' || replace(replace('org/' || c_mktsegment || ':7b', ':', '-'), '/', '_') || '__v' || (c_nationkey % 3) END AS stem FROM customer")
def run_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read_table(spark, sf_dir, "customer"), F.col("c_nationkey")
    model = F.concat(F.lit("org/"), "c_mktsegment", F.lit(":7b"))
    return c.select(sets.run_stem(F.lit("test"), F.when(n % 2 == 0, "regex").otherwise("llm"), model, F.concat(F.lit("v"), (n % 3).cast("string"))).alias("stem")).distinct()


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0)")
def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not done yet; every 11th of the even ones failed and is done again."""
    gold = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    done = gold.filter("id % 2 = 0").withColumn("exception", F.when(F.col("id") % 11 == 0, "timeout"))
    return sets.todo(gold, done)


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0) ORDER BY 1 LIMIT 100")
def todo_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rows to do under a total limit (the limit is the feature)."""
    return sets.limit_total(todo_anti(spark, sf_dir), "id", 150, 50)


@query("""WITH dn AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0 UNION SELECT -o_orderkey FROM orders)
SELECT count(*) FILTER (o_orderkey IN (SELECT k FROM dn)) AS n_done, count(*) FILTER (o_orderkey NOT IN (SELECT k FROM dn)) AS n_todo FROM orders""")
def todo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders are done; results that failed, repeat or belong to no order do not count."""
    gold = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    done = gold.filter("id % 2 = 0").withColumn("exception", F.when(F.col("id") % 11 == 0, "timeout"))
    strange = gold.select((-F.col("id")).alias("id"), F.lit(None).cast("string").alias("exception"))
    return sets.progress(gold, done.unionAll(done).unionAll(strange))


@query("SELECT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders")
def semi_has_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    # an order's lines are one row before they are dealt and sorted
    return sets.with_flag(orders, lines, "id", "has_lines")


@query(f"WITH {LINES} SELECT o_orderkey AS id, CAST(coalesce(n, 0) AS INT) AS n_lines FROM orders LEFT JOIN sums ON o_orderkey = k")
def pred_left_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line texts, an empty list where there are none."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    lines = R.lines_of(spark, sf_dir).groupBy(F.col("k").alias("id")).agg(F.collect_list("name").alias("lines"))
    return sets.attach_lines(orders, lines).select("id", F.size("lines").alias("n_lines"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.last_wins(read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'other' END AS split, format('{}_{:03d}', CASE s_nationkey % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'other' END, s_suppkey) AS record_id,
CASE s_suppkey % 3 WHEN 0 THEN 'Rules' WHEN 1 THEN 'Lines + model m:' || s_nationkey || '-b [v1]' ELSE 'Model 2 [v2]' END AS label FROM supplier"""
)
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split aliases, record ids and system labels."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    alias = F.when(F.col("s_nationkey") % 3 == 0, "dev").when(F.col("s_nationkey") % 3 == 1, "test").otherwise("other")
    stem = F.when(F.col("s_suppkey") % 3 == 0, "dev__rules").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("dev__lines__m-"), F.col("s_nationkey").cast("string"), F.lit("-b__v1"))).otherwise("dev__model__m-2__v2")
    labels = {"rules": "Rules", "lines": "Lines + model", "model__m-2": "Model 2"}
    split = sets.split_alias(alias)
    return s.select("s_suppkey", split.alias("split"), sets.record_id(split, F.col("s_suppkey")).alias("record_id"), sets.system_label(stem, labels).alias("label"))


# ---------------------------------------------------------------- scalar functions over whole tables

PRINTED = """SELECT o_orderkey AS id, o_orderkey % 6 AS v, CAST(floor(o_totalprice * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS c FROM orders"""


@query(
    f"""WITH p AS ({PRINTED}), w AS (SELECT *, format('{{:,}}', c // 100) AS g, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS d FROM p)
SELECT id, CASE v WHEN 0 THEN replace(g, ',', '.') WHEN 1 THEN g || '.' || d WHEN 2 THEN 'Rp. ' || replace(g, ',', '.') || ',' || d WHEN 3 THEN '(' || g || '.' || d || ')' WHEN 4 THEN '$' || g WHEN 5 THEN 'total: -' || replace(g, ',', ' ') END AS printed,
CASE v WHEN 0 THEN CAST(c // 100 AS DOUBLE) WHEN 1 THEN c / CAST(100 AS DOUBLE) WHEN 2 THEN c / CAST(100 AS DOUBLE) WHEN 3 THEN -c / CAST(100 AS DOUBLE) WHEN 4 THEN CAST(c // 100 AS DOUBLE) WHEN 5 THEN -CAST(c // 100 AS DOUBLE) END AS value FROM w"""
)
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals printed in six ways and parsed back."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), R.cents(F.col("o_totalprice")).alias("c"))
    g, d, v = F.format_number(F.floor(F.col("c") / 100), 0), F.lpad((F.col("c") % 100).cast("string"), 2, "0"), F.col("id") % 6
    dots = F.replace(g, F.lit(","), F.lit("."))
    printed = (
        F.when(v == 0, dots)
        .when(v == 1, F.concat(g, F.lit("."), d))
        .when(v == 2, F.concat(F.lit("Rp. "), dots, F.lit(","), d))
        .when(v == 3, F.concat(F.lit("("), g, F.lit("."), d, F.lit(")")))
        .when(v == 4, F.concat(F.lit("$"), g))
        .otherwise(F.concat(F.lit("total: -"), F.replace(g, F.lit(","), F.lit(" "))))
    )
    return o.select("id", printed.alias("printed")).withColumn("value", A.parse_amount(F.col("printed")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def parse_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities printed as 2, x2, 2.00, (2 or as a word, and parsed back."""
    q = F.col("l_quantity").cast("int").cast("string")
    v = F.col("l_linenumber") % 5
    printed = F.when(v == 0, q).when(v == 1, F.concat(F.lit("x"), q)).when(v == 2, F.concat(q, F.lit(",00"))).when(v == 3, F.concat(F.lit("("), q)).otherwise("pcs")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", A.parse_quantity(printed).alias("quantity"))


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT *, regexp_extract(t, '(?:^|[^\\p{L}\\p{M}\\p{N}_])(rp|idr|usd|sgd|myr|rm|eur|krw|php|thb|vnd)(?:[^\\p{L}\\p{M}\\p{N}_]|$)', 1) AS w FROM d)
SELECT doc_id, CASE WHEN contains(t, '€') THEN 'EUR' WHEN contains(t, '£') THEN 'GBP' WHEN contains(t, '¥') THEN 'JPY' WHEN contains(t, '₩') THEN 'KRW' WHEN contains(t, '₫') THEN 'VND' WHEN contains(t, '฿') THEN 'THB' WHEN contains(t, '₱') THEN 'PHP' WHEN contains(t, '$') THEN 'USD'
WHEN w IN ('rp', 'idr') THEN 'IDR' WHEN w IN ('myr', 'rm') THEN 'MYR' WHEN w <> '' THEN upper(w) END AS currency FROM w"""
)
def detect_currency_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", A.detect_currency(F.col("text")).alias("currency"))


@query("SELECT p_partkey, trim(regexp_replace(upper('  ' || p_name || ' (' || p_brand || ')--é ' || p_type), '[^A-Z0-9]+', ' ', 'g')) AS norm FROM part")
def norm_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", N.norm_name(F.concat(F.lit("  "), "p_name", F.lit(" ("), "p_brand", F.lit(")--é "), "p_type")).alias("norm"))


@query("SELECT doc_id, md5(nfc_normalize(text) || ' 1' || chr(8260) || '2 kg (10)') AS digest FROM documents")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC of whole texts whose letters are full-width, whose accents stand apart, and which end in signs that become several characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    apart = U.normal_form(F.col("text"), "NFKD")
    wide = F.translate(apart, letters, "".join(chr(ord(x) + 0xFEE0) for x in letters))
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(wide, F.lit(" ½ ㎏ ⑽")).alias("text"))
    return U.normalize_unicode(texts, "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice + (o_orderkey % 5) * CAST(300 AS DOUBLE) END AS b FROM orders)
SELECT id, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a - b) <= greatest(CAST(1 AS DOUBLE), CAST(0.005 AS DOUBLE) * greatest(abs(a), abs(b))) END AS same FROM p"""
)
def money_equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))
    b = F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") + (F.col("o_orderkey") % 5) * 300.0)
    return o.select(F.col("o_orderkey").alias("id"), A.money_equal(a, b, 1.0, 0.005).alias("same"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE regexp_replace(format('{:,.2f}', o_totalprice), '\\.?0+$', '') END AS shown FROM orders""")
def format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), A.format_money(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))).alias("shown"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d.,\\s]*\\d|\\d')) AS tok FROM documents),
v AS (SELECT doc_id, regexp_replace(tok, '[^0-9]', '', 'g') AS n FROM t UNION SELECT doc_id, CASE WHEN regexp_matches(tok, '[.,]00$') THEN regexp_replace(regexp_replace(tok, '[^0-9]', '', 'g'), '00$', '') ELSE regexp_replace(tok, '[^0-9]', '', 'g') END FROM t
UNION SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(tok, '\\s+')), '[^0-9]', '', 'g') FROM t)
SELECT d.doc_id, count(v.n) AS n_numbers, md5(coalesce(string_agg(v.n, ',' ORDER BY v.n), '')) AS digest FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id"""
)
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit strings of all number tokens of each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", A.number_strings(F.split("text", "\n(?!\\s*\\d)(?<!\\d\n)", 1)).alias("n"))
    return docs.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.md5(F.array_join(F.sort_array("n"), ",").cast("binary")).alias("digest"))


@query(f"""WITH {LINES} SELECT k AS id, CAST(2 * n + 2 + CASE WHEN disc IS NULL THEN 0 ELSE 1 END + CASE WHEN svc IS NULL THEN 0 ELSE 1 END + CASE WHEN tax IS NULL THEN 0 ELSE 1 END + CASE WHEN k % 13 <> 0 THEN 1 ELSE 0 END AS INT) AS n_amounts,
round((k % 50) + q + (2 * sub + coalesce(disc, 0) + coalesce(svc, 0) + coalesce(tax, 0) + CASE WHEN k % 13 <> 0 THEN total ELSE 0 END) / CAST(100 AS DOUBLE), 2) AS total FROM gold JOIN (SELECT k, sum(CAST(qty AS INT)) AS q FROM ln GROUP BY k) USING (k)""")
def amounts_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All amounts on the printed lines of a record, in full-width digits on every other record."""
    rows = R.printed_lines(R.gold_records(spark, sf_dir))
    line = lambda x: F.when(F.col("id") % 2 == 0, F.translate(x, "0123456789.,", "０１２３４５６７８９．，")).otherwise(x)
    found = rows.select("id", F.flatten(F.transform("lines", lambda x: A.amounts_in(line(x)))).alias("a"))
    return found.select("id", F.size("a").alias("n_amounts"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS amount, trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', ' ', 'g')) || ' ' || o_orderkey || 'KG' AS name FROM orders")
def wide_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and names in full-width characters."""
    o = read_table(spark, sf_dir, "orders")
    plain = "0123456789.,- ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    wide = lambda c: F.translate(c, plain, "".join(chr(0x3000 if x == " " else ord(x) + 0xFEE0) for x in plain))
    amount = F.concat(F.lit("￥ "), wide(F.format_number(F.round("o_totalprice", 2), 2)))
    name = F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit("kg"))
    return o.select(F.col("o_orderkey").alias("id"), A.parse_amount(amount).alias("amount"), N.norm_name(wide(name)).alias("name"))


@query()
def amounts_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts on every line of every document (the pattern looks ahead, which the oracle's regular expressions cannot)."""
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    found = lines.select("doc_id", "line", A.amounts_in(F.col("t")).alias("amounts")).filter(F.size("amounts") > 0)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("amounts")).alias("n_amounts"))


# ---------------------------------------------------------------- extraction, layout, ingest


@query(
    f"""WITH {LINES} SELECT k AS id, CAST(n AS INT) + CAST(1 AS INT) AS n_items, sub / CAST(100 AS DOUBLE) AS subtotal, disc / CAST(100 AS DOUBLE) AS discount, tax / CAST(100 AS DOUBLE) AS tax, svc / CAST(100 AS DOUBLE) AS service_charge,
CASE WHEN k % 13 <> 0 THEN total / CAST(100 AS DOUBLE) END AS total FROM gold"""
)
def extract_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records extracted from printed lines (the store's number counts as an amount, so its line is an item)."""
    rows = extract.with_extraction(R.printed_lines(R.gold_records(spark, sf_dir)))
    r = F.col("receipt")
    return rows.select("id", F.size(r["items"]).alias("n_items"), *[r[f].alias(f) for f in ("subtotal", "discount", "tax", "service_charge", "total")])


@query(
    f"""WITH {LINES}, x AS (SELECT *, sub + 100 * (k % 50) AS s FROM gold),
y AS (SELECT k, k % 13 = 0 AS lacks, abs(s - sub) <= greatest(100, 0.005 * greatest(abs(s), abs(sub))) OR (coalesce(tax, 0) <> 0 AND abs(s - sub - tax) <= greatest(100, 0.005 * greatest(abs(s), abs(sub + tax)))) AS ok FROM x)
SELECT CASE WHEN ok AND NOT lacks THEN 'auto_approve' ELSE 'review' END AS decision, CASE WHEN NOT lacks THEN 'IDR' END AS currency, CAST(100 - CASE WHEN lacks THEN 50 ELSE 0 END - CASE WHEN ok THEN 0 ELSE 40 END - CASE WHEN lacks AND NOT ok THEN 5 ELSE 0 END AS DOUBLE) / 100 AS confidence, count(*) AS n FROM y GROUP BY ALL"""
)
def extract_and_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: lines, record, currency, validation, decision."""
    rows = extract.with_extraction(R.printed_lines(R.gold_records(spark, sf_dir)), out="pred")
    rows = validate.with_validation(ingest.with_currency(rows), "pred")
    return rows.groupBy("decision", F.col("pred")["currency"].alias("currency"), "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT l_orderkey AS id, l_linenumber % 3 AS r, l_extendedprice AS x, l_quantity AS y, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
l AS (SELECT id, r, avg(y) AS y, string_agg(t, ' ' ORDER BY x, y, t) AS t FROM w GROUP BY id, r) SELECT id, string_agg(t, chr(10) ORDER BY y, t) AS lines FROM l GROUP BY id"""
)
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words on three rows."""
    li, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    words = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"), F.lit(0).alias("group_id"), (F.col("l_linenumber") % 3).alias("row_id"), F.lit(True).alias("has_row_id"), x.alias("x1"), x.alias("x3"), y.alias("y1"), y.alias("y3"), F.col("p_name").alias("text")
    )
    return layout.word_lines(words).select("id", F.array_join("lines", "\n").alias("lines"))


@query(f"WITH {LINES} SELECT k AS id, string_agg(CAST(CAST(qty AS INT) AS VARCHAR) || ' ' || name || '   ' || CAST(cents AS VARCHAR), chr(10) ORDER BY j) AS lines FROM ln GROUP BY k")
def reconstruct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes for each order line, read back as lines; the third stands apart."""
    lines = R.lines_of(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("place", "name", "qty", "cents"))).alias("xs"))

    def boxes(x, i):
        top = i.cast("double") * 20.0
        point = lambda a, b: F.array(F.lit(a).cast("double"), b)
        box = lambda text, left, right: F.struct(F.array(point(left, top), point(right, top), point(right, top + 12), point(left, top + 12)).alias("quad"), text.alias("text"), F.lit(1.0).alias("score"))
        return F.array(box(x["cents"].cast("string"), 400.0, 450.0), box(x["qty"].cast("int").cast("string"), 0.0, 20.0), box(x["name"], 30.0, 150.0))

    placed = lines.select(F.col("k").alias("id"), F.flatten(F.transform("xs", boxes)).alias("boxes"))
    return layout.reconstruct_lines(placed).select("id", F.array_join("lines", "\n").alias("lines"))


@query(
    f"""WITH {LINES}, t AS (SELECT k, j, CAST(CAST(qty AS INT) AS VARCHAR) || ' ' || name || '   ' || CAST(cents AS VARCHAR) || CASE WHEN k % 3 = 2 AND j = 0 AND n > 1 THEN '   #' ELSE '' END AS line FROM ln JOIN sums USING (k))
SELECT k AS id, string_agg(line, chr(10) ORDER BY j) AS lines FROM t GROUP BY k"""
)
def reconstruct_lines_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are not straight: turned by up to 14 degrees; boxes of a line that overlap in part; a box as tall as two lines, which goes to
    the first of them."""
    lines = R.lines_of(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("place", "name", "qty", "cents"))).alias("xs"))
    kind, angle = F.col("k") % 3, F.radians(F.when(F.col("k") % 3 == 0, (F.col("k") % 15).cast("double")).otherwise(0.0))

    def box(text, left, right, top, bottom):
        point = lambda x, y: F.array(F.lit(x) * F.cos(angle) - y * F.sin(angle), F.lit(x) * F.sin(angle) + y * F.cos(angle))
        return F.struct(F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom)).alias("quad"), text.alias("text"), F.lit(1.0).alias("score"))

    def boxes(x, i):
        top = i.cast("double") * 20.0
        low = top + F.when(kind == 1, 4.0).otherwise(0.0)
        return F.array(box(x["cents"].cast("string"), 400.0, 450.0, low, low + 12), box(x["qty"].cast("int").cast("string"), 0.0, 20.0, top, top + 12), box(x["name"], 30.0, 150.0, low, low + 12))

    tall = F.when((kind == 2) & (F.size("xs") > 1), F.array(box(F.lit("#"), 500.0, 510.0, F.lit(0.0), F.lit(32.0))))
    placed = lines.select(F.col("k").alias("id"), F.flatten(F.array(F.flatten(F.transform("xs", boxes)), F.coalesce(tall, F.slice(F.flatten(F.transform("xs", boxes)), 1, 0)))).alias("boxes"))
    return layout.reconstruct_lines(placed).select("id", F.array_join("lines", "\n").alias("lines"))


@query(
    f"""WITH {LINES} SELECT k AS id, CAST(CASE k % 4 WHEN 0 THEN n WHEN 1 THEN 1 WHEN 2 THEN n ELSE 0 END AS INT) AS n_items, CASE k % 4 WHEN 0 THEN sub WHEN 1 THEN f WHEN 2 THEN sub ELSE 0 END / CAST(100 AS DOUBLE) AS items_total, sub / CAST(100 AS DOUBLE) AS subtotal,
disc / CAST(100 AS DOUBLE) AS discount, total / CAST(100 AS DOUBLE) AS total FROM gold JOIN (SELECT k, cents AS f FROM ln WHERE j = 0) USING (k)"""
)
def tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled trees with a list, a single entry, mixed members or nothing under menu; amounts as text, lists or numbers."""
    return tree_table(spark, sf_dir)


def tree_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw: every gold record as a labelled tree."""
    rows = R.gold_records(spark, sf_dir)
    k, quote = F.col("id"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    entry = lambda x: F.concat(F.lit('{"nm":'), quote(x["name"]), F.lit(',"cnt":"x'), x["quantity"].cast("int").cast("string"), F.lit('","price":'), quote(R.grouped(F.round(x["line_total"] * 100).cast("long"))), F.lit(',"sub":{"nm":"extra"}}'))
    each = F.transform(F.col("gold")["items"], entry)
    menu = (
        F.when(k % 4 == 0, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
        .when(k % 4 == 1, F.get(each, F.lit(0)))
        .when(k % 4 == 2, F.concat(F.lit('["junk",{"nm":null,"price":"5"},'), F.array_join(each, ","), F.lit("]")))
        .otherwise("null")
    )
    sub = F.concat(F.lit('{"subtotal_price":["none",'), quote(R.grouped(F.col("sub"))), F.lit("]"), F.coalesce(F.concat(F.lit(',"discount_price":"-'), R.grouped(F.col("disc")), F.lit('"')), F.lit("")), F.lit("}"))
    total = F.concat(F.lit('{"total_price":'), F.when(k % 2 == 0, R.money(F.col("total")).cast("decimal(20,2)").cast("string")).otherwise(quote(F.concat(F.lit("Rp "), R.grouped(F.col("total"))))), F.lit("}"))
    raw = F.concat(F.lit('{"menu":'), menu, F.lit(',"sub_total":'), F.when(k % 3 == 1, F.concat(F.lit("["), sub, F.lit("]"))).otherwise(sub), F.lit(',"total":'), total, F.lit("}"))
    return rows.select("id", raw.alias("raw"))


def tree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ingest.with_tree_record(tree_raw(spark, sf_dir)).select("id", "gold")
    g = F.col("gold")
    return gold.select("id", F.size(g["items"]).alias("n_items"), F.round(validate.total_of(validate.line_totals(g["items"])), 2).alias("items_total"), g["subtotal"].alias("subtotal"), g["discount"].alias("discount"), g["total"].alias("total"))


@query(
    """SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'json: malformed' WHEN 2 THEN 'json: not an object' WHEN 3 THEN 'schema: items' ELSE NULL END AS error, o_orderkey % 5 IN (0, 4) AS parsed, CASE WHEN o_orderkey % 5 IN (0, 4) THEN o_custkey % 100 ELSE -1 END AS total, count(*) AS n FROM orders GROUP BY ALL"""
)
def parse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs: objects, broken text, arrays and wrong items, with the reason each one fails."""
    o, k = read_table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    total = F.concat(F.lit('"total":"'), (F.col("o_custkey") % 100).cast("string"), F.lit('"'))
    raw = (
        F.when(k == 0, F.concat(F.lit('{"items":[{"name":" a ","quantity":"2x"}],'), total, F.lit("}")))
        .when(k == 1, "not json")
        .when(k == 2, "[1, 2]")
        .when(k == 3, '{"items":5}')
        .otherwise(F.concat(F.lit('{"items":{"name":"one"},"unknown":1,'), total, F.lit("}")))
    )
    rows = ingest.with_parsed_output(o.select(raw.alias("raw")))
    return rows.groupBy("error", F.col("pred").isNotNull().alias("parsed"), F.coalesce(F.col("pred")["total"].cast("long"), F.lit(-1)).alias("total")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, md5('Document text, one printed line per line:' || chr(10) || '<receipt>' || chr(10) || text || chr(10) || '</receipt>') AS digest FROM conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(ingest.prompt(F.split("text", "\n"), "Extract the record.")[1]["content"].cast("binary")).alias("digest"))


# ---------------------------------------------------------------- error analysis


def with_errors_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.printed_lines(R.predictions(spark, sf_dir))
    printed = lambda c: F.when(F.col(c).isNotNull(), R.grouped(F.col(c)))
    fields = {"total": "total", "subtotal": "sub", "tax": "tax", "service_charge": "svc"}
    raw_gold = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[printed(c) for c in fields.values()]))
    raw_pred = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.when(F.col("pred")[f].isNotNull(), R.grouped(F.round(F.col("pred")[f] * 100).cast("long"))) for f in fields]))
    return rows.withColumns({"raw_gold": raw_gold, "raw_pred": raw_pred})


NUMBERS = """nums AS (SELECT k, CAST(cents AS VARCHAR) AS n FROM ln UNION ALL SELECT k, CAST(CAST(qty AS INT) AS VARCHAR) FROM ln UNION ALL SELECT k, CAST(k % 50 AS VARCHAR) FROM gold
  UNION ALL SELECT k, CAST(sub AS VARCHAR) FROM gold UNION ALL SELECT k, CAST(disc AS VARCHAR) FROM gold WHERE disc IS NOT NULL UNION ALL SELECT k, CAST(svc AS VARCHAR) FROM gold WHERE svc IS NOT NULL
  UNION ALL SELECT k, CAST(tax AS VARCHAR) FROM gold WHERE tax IS NOT NULL UNION ALL SELECT k, CAST(total AS VARCHAR) FROM gold WHERE k % 13 <> 0),
nl AS (SELECT k, list(DISTINCT x) AS ns FROM (SELECT k, n AS x FROM nums UNION ALL SELECT k, CASE WHEN length(n) > 2 AND n LIKE '%00' THEN left(n, length(n) - 2) ELSE n END FROM nums) GROUP BY k)"""

SCALAR = f"""WITH {PRED}, {NUMBERS},
fl AS (SELECT system, k, 'total' AS field, total AS p, gtotal AS g FROM pr UNION ALL SELECT system, k, 'subtotal', sub, gsub FROM pr UNION ALL SELECT system, k, 'tax', tax, gtax FROM pr UNION ALL SELECT system, k, 'service_charge', svc, gsvc FROM pr),
er AS (SELECT fl.*, list_contains(ns, CAST(g AS VARCHAR)) OR list_contains(ns, CAST(CAST(round_even(g / CAST(100 AS DOUBLE), 0) AS BIGINT) AS VARCHAR)) AS there FROM fl JOIN nl USING (k) WHERE NOT (p IS NOT DISTINCT FROM g OR coalesce(abs(p - g) <= 50, false))),
bk AS (SELECT *, CASE WHEN g IS NULL THEN 'spurious' WHEN NOT there THEN 'ocr' WHEN p IS NULL THEN 'missed' ELSE 'wrong_value' END AS bucket FROM er)"""


@query(SCALAR + " SELECT system, k AS id, field, bucket, g / CAST(100 AS DOUBLE) AS gold, p / CAST(100 AS DOUBLE) AS pred FROM bk")
def error_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.scalar_errors(with_errors_input(spark, sf_dir), ("system", "id"))


@query(
    SCALAR
    + """, ord AS (SELECT * FROM (VALUES (0, 'ocr'), (1, 'missed'), (2, 'wrong_value'), (3, 'spurious'), (4, 'normalisation'), (5, 'item_ocr'), (6, 'item_missed'), (7, 'item_price_only'), (8, 'item_extra')) t(place, bucket))
SELECT place, ord.bucket, count(bk.k) AS count, coalesce(string_agg(system || lpad(CAST(bk.k AS VARCHAR), 12, '0') || ' ' || field, ',' ORDER BY system || lpad(CAST(bk.k AS VARCHAR), 12, '0') || ' ' || field) FILTER (rk <= 6), '') AS examples
FROM ord LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY system || lpad(CAST(k AS VARCHAR), 12, '0') || ' ' || field) AS rk FROM bk) bk ON bk.bucket = ord.bucket GROUP BY place, ord.bucket"""
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts with the first six examples (the six are the feature)."""
    found = error_scalars(spark, sf_dir)
    report = errors.bucket_report(found, F.concat("system", F.lpad(F.col("id").cast("string"), 12, "0"), F.lit(" "), "field"))
    return report.select("place", "bucket", "count", F.array_join("examples", ",").alias("examples"))


def _error_items_sql(unseen: str) -> str:
    """unseen: condition under which a missed item's name is not on the lines."""
    return f"""WITH {MATCH}, {NUMBERS}, mg AS (SELECT pr.system, pr.k, coalesce(price.p, []) AS pp, coalesce(price.g, []) AS pg, coalesce(named.p, []) AS np, coalesce(named.g, []) AS ng FROM pr LEFT JOIN gr USING (system, k)),
go AS (SELECT system, mg.k, j AS item, CASE WHEN NOT list_contains(ns, CAST(CAST(round_even(cents / CAST(100 AS DOUBLE), 0) AS BIGINT) AS VARCHAR)) THEN 'item_ocr'
        WHEN list_contains(ng, j) AND NOT list_contains(pp, np[list_position(ng, j)]) THEN 'item_price_only' WHEN {unseen} THEN 'item_ocr' ELSE 'item_missed' END AS bucket FROM mg JOIN ln ON mg.k = ln.k JOIN nl ON nl.k = ln.k WHERE NOT list_contains(pg, j)),
po AS (SELECT pi.system, pi.k, pi.i AS item FROM pi JOIN mg USING (system, k) WHERE NOT list_contains(pp, pi.i) AND NOT (list_contains(np, pi.i) AND NOT list_contains(pg, ng[list_position(np, pi.i)])))
SELECT system, k AS id, 'gold' AS side, CAST(item AS INT) AS item, bucket FROM go UNION ALL SELECT system, k, 'pred', CAST(item AS INT), 'item_extra' FROM po"""


@query(_error_items_sql("false"))
def error_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched items by cause (best-window name search in Python only where nothing else decides)."""
    rows = score.with_matches(with_errors_input(spark, sf_dir))
    return errors.item_errors(rows, keys=("system", "id")).select("system", "id", "side", "item", "bucket")


@query(_error_items_sql("mg.k % 2 = 1"))
def error_items_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every other record's names are unreadable on its lines: a missed item with a legible price is then a reading error."""
    rows = score.with_matches(with_errors_input(spark, sf_dir))
    blurred = F.transform("lines", lambda x: F.regexp_replace(x, "[A-Za-z]", "#"))
    rows = rows.withColumn("lines", F.when(F.col("id") % 2 == 1, blurred).otherwise(F.col("lines")))
    return errors.item_errors(rows, keys=("system", "id")).select("system", "id", "side", "item", "bucket")


@query(
    f"""WITH {LINES}, g AS (SELECT *, (sub // 100) AS a, lpad(CAST(sub % 100 AS VARCHAR), 2, '0') AS b FROM gold)
SELECT k AS id, 'none' AS subtotal, CASE WHEN k % 2 = 1 THEN 'Rp ' || format('{{:,}}', total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') END AS total, CAST(NULL AS VARCHAR) AS tax FROM g"""
)
def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored fields as the labelled trees print them: of a list the first element; numbers are left out of the comparison."""
    found = tree_raw(spark, sf_dir).select("id", ingest.printed_fields(F.try_parse_json("raw")).alias("m"))
    return found.select("id", F.col("m")["subtotal"].alias("subtotal"), F.when(F.col("id") % 2 == 1, F.col("m")["total"]).alias("total"), F.col("m")["tax"].alias("tax"))


@query("""SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 3 WHEN 1 THEN 'normalisation' WHEN 2 THEN 'wrong_value' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'missed' ELSE 'ocr' END END AS bucket FROM lineitem""")
def error_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a total that is read wrongly: a decimal point read as a thousands separator (the printed digits agree, the parse
    differs), another amount read, or none read of a total that is, or is not, on the lines."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, none = cents * 10 + 1, F.lit(None).cast("double")  # three decimals: 1234.561 is printed, 1234561 read
    printed = lambda v: F.concat(F.floor(v / 1000).cast("string"), F.lit("."), F.lpad((v % 1000).cast("string"), 3, "0"))
    rec = lambda v: F.struct(v.alias("total"), *[none.alias(f) for f in ("subtotal", "tax", "service_charge")])
    kind, text, other = F.col("l_linenumber") % 3, printed(whole), whole * 3
    read = F.when(kind == 1, whole.cast("double")).when(kind == 2, other / 1000.0)
    shown = F.when(kind == 1, text).when(kind == 2, printed(other))
    lines = F.when((kind == 0) & (F.col("l_partkey") % 2 == 1), F.array(F.lit("no sum"))).otherwise(F.array(text))
    rows = li.withColumns({"gold": rec(whole / 1000.0), "pred": rec(read), "raw_gold": F.create_map(F.lit("total"), text), "raw_pred": F.create_map(F.lit("total"), shown), "lines": lines})
    keys = tuple(li.columns)
    return errors.scalar_errors(rows, keys).select(*keys, "bucket")


# ---------------------------------------------------------------- monitoring and reviews


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: type as mode, value as seconds, props.k as tokens."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"),
        F.when(F.col("event_id") % 3 == 0, "app").otherwise("eval").alias("source"),
        F.col("event_type").alias("mode"),
        F.when(F.col("user_id") % 4 != 3, F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string"))).alias("model"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("t_ocr"),
        (F.col("value") * 2).alias("t_llm"),
        F.col("value").alias("t_total"),
        k.alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        F.when(k > 90, "length").otherwise("stop").alias("done_reason"),
        F.when(F.col("value") < 10, "auto_approve").otherwise("review").alias("decision"),
    )


TRACES = """tr AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'app' ELSE 'eval' END AS source, event_type AS mode, CASE WHEN user_id % 4 <> 3 THEN 'model-' || (user_id % 4) END AS model, CASE WHEN event_id % 10 <> 0 THEN value END AS t_ocr,
value * 2 AS t_llm, value AS t_total, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _q(c: str, q: float) -> str:
    return f"round(quantile_cont({c}, {q}), 6)"


@query(
    f"""WITH {TRACES} SELECT mode, count(*) AS n, {_q("coalesce(t_ocr, 0)", 0.5)} AS ocr_p50, {_q("coalesce(t_ocr, 0)", 0.95)} AS ocr_p95, {_q("t_llm", 0.5)} AS llm_p50, {_q("t_llm", 0.95)} AS llm_p95, {_q("coalesce(t_ocr, 0) + t_llm", 0.5)} AS total_p50,
{_q("coalesce(t_ocr, 0) + t_llm", 0.95)} AS total_p95, round(60 / avg(coalesce(t_ocr, 0) + t_llm), 6) AS per_minute, round(avg(k), 6) AS prompt_tokens_mean, round(avg(k * 2), 6) AS completion_tokens_mean, count(*) FILTER (k > 90) AS truncated FROM tr GROUP BY mode"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitor.run_stats(traces(spark, sf_dir), "mode"), "mode", "n", "truncated", places=6)


@query(f"WITH {TRACES} SELECT mode, model, count(*) AS n, {_q('t_total', 0.5)} AS t_total_p50, {_q('t_total', 0.95)} AS t_total_p95, {_q('t_ocr', 0.5)} AS t_ocr_p50, {_q('t_ocr', 0.95)} AS t_ocr_p95 FROM tr WHERE model IS NOT NULL GROUP BY mode, model")
def mode_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitor.group_report(traces(spark, sf_dir), ("mode", "model"), ("t_total", "t_ocr")), "mode", "model", "n", places=6)


@query(
    f"WITH {TRACES} SELECT mode, count(*) AS n, {_q('t_total', 0.5)} AS p50, {_q('t_total', 0.95)} AS p95, true AS p50_near, true AS p95_near FROM tr GROUP BY mode"
)
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from hourly sketches that were written and merged, beside the exact ones: whether the share of smaller values is within the stated
    rank error of the point's."""
    rows = traces(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_micros"))
    kept = keep(monitor.sketches(rows, ("mode",), ("t_total",)), "sketches")
    found = monitor.merged_percentiles(kept, ("mode",), ("t_total",))
    exact = monitor.group_report(rows, ("mode",), ("t_total",)).select("mode", F.col("t_total_p50").alias("p50"), F.col("t_total_p95").alias("p95"))
    below = {p: F.avg(F.when(F.col("t_total") < F.col(f"t_total_{p}"), 1.0).otherwise(0.0)) for p in monitor.POINTS}
    upto = {p: F.avg(F.when(F.col("t_total") <= F.col(f"t_total_{p}"), 1.0).otherwise(0.0)) for p in monitor.POINTS}
    near = {f"{p}_near": (below[p] <= q + monitor.RANK_ERROR) & (upto[p] >= q - monitor.RANK_ERROR) for p, q in monitor.POINTS.items()}
    ranks_ = rows.filter("t_total IS NOT NULL").join(F.broadcast(found), "mode").groupBy("mode").agg(*[c.alias(n) for n, c in near.items()])
    return rounded(found.select("mode", "n").join(exact, "mode").join(ranks_, "mode"), "mode", "n", "p50_near", "p95_near", places=6)


@query(f"WITH {TRACES} SELECT mode, model, round_even(avg(k), 0) AS prompt_tokens, round_even(avg(k * 2), 0) AS completion_tokens FROM tr WHERE model IS NOT NULL GROUP BY mode, model")
def mean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.mean_tokens(traces(spark, sf_dir), ("mode", "model"), ("prompt_tokens", "completion_tokens"))


@query(f"WITH {TRACES} SELECT count(*) AS n, {_q('t_total', 0.5)} AS p50, {_q('t_total', 0.95)} AS p95, round(100 * avg(CAST(t_total < 10 AS INT)), 6) AS auto_approve_pct FROM tr")
def monitor_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitor.headline(traces(spark, sf_dir)), "n", places=6)


@query(f"WITH {TRACES} SELECT id, mode, model, t_total FROM tr WHERE id IS NOT NULL AND mode IS NOT NULL AND model IS NOT NULL AND t_total IS NOT NULL")
def complete_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that lack none of what is drawn."""
    return sets.complete(traces(spark, sf_dir).select("id", "mode", "model", "t_total"))


@query(f"WITH {TRACES} SELECT id, mode, t_total FROM tr WHERE source = 'app' ORDER BY id DESC LIMIT 50")
def latest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 traces of one source (the limit is the feature)."""
    return monitor.latest(traces(spark, sf_dir), 50, "app").select("id", "mode", "t_total")


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return read_table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers, round(avg(c_acctbal), 4) AS balance, round(max(c_acctbal), 4) AS highest FROM customer GROUP BY 1)
SELECT nation, CASE metric WHEN 'customers' THEN 'Customers' WHEN 'balance' THEN 'Mean balance' ELSE metric END AS metric, value FROM (UNPIVOT (SELECT nation, CAST(customers AS DOUBLE) AS customers, balance, highest FROM c) ON customers, balance, highest INTO NAME metric VALUE value)"""
)
def melt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).cast("double").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"), F.round(F.max("c_acctbal"), 4).alias("highest"))
    return sets.to_long(wide, ["nation"], ["customers", "balance", "highest"], {"customers": "Customers", "balance": "Mean balance"})


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a user adds a review; purchases approve it, errors reject it."""
    e = read_table(spark, sf_dir, "events").withColumns({"review_id": F.col("user_id").cast("string"), "ts": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "confidence": F.col("value")})
    first = e.groupBy("review_id").agg(F.min_by(F.struct("ts", "confidence", "event_id"), "event_id").alias("x")).select("review_id", "x.*")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected")
    return review.events(first, "added", F.col("event_id")).unionByName(review.events(e.withColumn("status", status).filter("status IS NOT NULL"), "resolved", F.col("event_id")))


REVIEWS = """st AS (SELECT user_id, min(event_id) AS a, max(event_id) FILTER (event_type IN ('purchase', 'error')) AS r FROM events GROUP BY user_id),
rv AS (SELECT CAST(st.user_id AS VARCHAR) AS review_id, a AS seq_created, coalesce(r, -1) AS seq_reviewed, CASE e.event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status FROM st LEFT JOIN events e ON e.event_id = st.r)"""


@query(f"WITH {REVIEWS} SELECT * FROM rv")
def latest_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.state(review_log(spark, sf_dir)).select("review_id", "seq_created", F.coalesce("seq_reviewed", F.lit(-1)).alias("seq_reviewed"), "status")


@query(f"WITH {REVIEWS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status <> 'pending') AS done FROM rv")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.by_status(review.state(review_log(spark, sf_dir)))


@query(f"WITH {REVIEWS} SELECT row_number() OVER (ORDER BY seq_created) AS place, review_id FROM rv WHERE status = 'approved'")
def reviews_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of one status in the order they were added."""
    return review.placed(review.state(review_log(spark, sf_dir)), "approved").select("place", "review_id")


@query(f"WITH {REVIEWS} SELECT * FROM rv")
def review_state_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a log that comes in three parts, late ones first, and is compacted in between; the second compaction deletes what it covers."""
    log, events = compaction.EventLog(spark, folder(spark, "reviews")), review_log(spark, sf_dir)
    for part in (2, 0, 1):
        log.append(events.filter(F.pmod(F.xxhash64("review_id", "seq"), F.lit(3)) == part))
        if part < 2 and log.compact() and part == 0:
            log.vacuum()
    return log.state().select("review_id", "seq_created", F.coalesce("seq_reviewed", F.lit(-1)).alias("seq_reviewed"), "status")


@query(f"WITH {PRED} SELECT va.system, va.decision, count(*) AS n FROM va GROUP BY ALL")
def review_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, checked again after an edit that adds a nameless item (which does not count)."""
    rows = R.predictions(spark, sf_dir)
    blank = F.array(F.get(F.col("pred")["items"], F.lit(0)).withField("name", F.lit(" ")))
    edited = rows.withColumn("receipt", F.col("pred").withField("items", F.concat(F.col("pred")["items"], blank)))
    return review.corrected(edited).groupBy("system", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS mode, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time: the batch form of the streaming report."""
    e = read_table(spark, sf_dir, "events")
    g = e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "mode", "n", "total")
