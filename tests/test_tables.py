"""Files, sets, monitoring, reviews, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tallymill.functions import stats
from tallymill.operators import monitor, review, sets
from tallymill.sources import files
from tallymill.streaming import monitor as stream


def test_jsonl(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none*"), "id string").count() == 0
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "dev__rules.jsonl").write_text('{"id":"a","x":1}\n\n{"id":"b","x":2}\n{"id":"a","x":3}\n')
    (tmp_path / "run" / "dev__model.jsonl").write_text('{"id":"a","x":9}\n')
    rows = files.read_jsonl_ordered(spark, str(tmp_path / "run" / "dev__rules.jsonl"), "id string, x int")
    assert {r.id: r.x for r in sets.last_wins(rows, "id", "file_pos").collect()} == {"a": 3, "b": 2}
    runs = files.read_runs(spark, str(tmp_path / "run" / "*.jsonl"), "id string, x int")
    assert {r.stem for r in runs.collect()} == {"dev__rules", "dev__model"} and files.latest_run(runs).count() == 3
    out = str(tmp_path / "out")
    files.append_jsonl(rows.select("id", "x"), out)
    files.append_jsonl(rows.select("id", "x"), out)
    assert files.read_jsonl(spark, out, "id string, x int").count() == 6
    files.write_sorted_jsonl(rows.select("id", "x"), str(tmp_path / "sorted"))
    files.write_csv(rows.select("id", "x"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "id string, x int").count() == 3 and files.read_csv(spark, str(tmp_path / "no"), "id string") is None
    files.write_document(rows.limit(1).select("id"), str(tmp_path / "doc"))
    assert files.read_json_document(spark, str(tmp_path / "doc"), "id string").first().id
    rows.createOrReplaceTempView("rows_view")
    assert files.query(spark, "SELECT count(*) AS n FROM rows_view WHERE id = :id", id="a").first().n == 2


def test_progress_and_complete(spark):
    gold = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = spark.createDataFrame([("a", None), ("a", ""), ("b", "timeout"), ("z", None)], "id string, exception string")
    assert sets.progress(gold, done).collect() == [(1, 2)]
    assert sets.progress(gold, done.select("id")).collect() == [(2, 1)]
    assert sets.progress(gold.limit(0), done).collect() == [(0, 0)]
    rows = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), "x"), (3, 2.0, "y")], "i int, v double, s string")
    assert [r.i for r in sets.complete(rows).collect()] == [3]
    assert sorted(r.i for r in sets.complete(rows, "v").collect()) == [1, 3]


def test_settings_and_splits(spark, tmp_path):
    from tallymill import config

    assert config.load().abs_tol == 1.0 and config.load() is config.load()
    (tmp_path / "c.json").write_text('{"rel_tol": 0.1}')
    assert config.load(str(tmp_path / "c.json")).rel_tol == 0.1
    (tmp_path / "c.yaml").write_text("# own\napprove_threshold: 0.9\ngold: there\n")
    (tmp_path / "empty.yml").write_text("")
    assert (config.load(str(tmp_path / "c.yaml")).approve_threshold, config.load(str(tmp_path / "c.yaml")).gold) == (0.9, "there")
    assert config.load(str(tmp_path / "empty.yml")) == config.load()
    (tmp_path / "bad.json").write_text('{"typo": 1}')
    with pytest.raises(ValueError, match="typo"):
        config.load(str(tmp_path / "bad.json"))
    (tmp_path / "validation.jsonl").write_text('{"id":"a","lines":["x"]}\n{"id":"a","lines":["y"]}\n')
    assert [(r.id, r.lines) for r in files.read_ocr(spark, str(tmp_path), "dev").collect()] == [("a", ["y"])]
    assert files.read_gold(spark, str(tmp_path), "test", "id string").count() == 0


def test_sets(spark):
    gold = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    preds = spark.createDataFrame([("a", None), ("b", "boom"), ("z", "")], "id string, exception string")
    assert [r.id for r in sets.todo(gold, preds).orderBy("id").collect()] == ["b", "c"]
    assert [r.id for r in sets.missing_gold(preds, gold).collect()] == ["z"] and sets.attach_gold(preds, gold).count() == 2
    assert [r.id for r in sets.usable(preds).orderBy("id").collect()] == ["a", "z"]
    assert sets.limit_total(gold, "id", 2, 1).count() == 1 and sets.limit_total(gold, "id", 1, 5).count() == 0
    lines = spark.createDataFrame([("a", ["x"])], "id string, lines array<string>")
    assert {r.id: r.lines for r in sets.attach_lines(gold, lines).collect()} == {"a": ["x"], "b": [], "c": []}
    runs = spark.createDataFrame([("s", i) for i in "abc"] + [("t", i) for i in "ab"] + [("u", i) for i in "bc"], "system string, id string")
    assert [r.id for r in sets.common_subset(runs, 3).collect()] == ["b"]
    assert sorted(r.system for r in sets.covering(runs, spark.createDataFrame([("b",), ("c",)], "id string")).collect()) == ["s", "u"]
    assert sets.common_subset(runs.filter("system = 's'"), 3).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("dev__regex",), ("dev__ocr__m-7b-q__v2",), ("test__vision__v-3b__v1",)], "s string").coalesce(1)
    labels = {"regex": "Rules", "ocr__m-7b-q": "Known"}
    assert [r[0] for r in df.select(sets.system_label(F.col("s"), labels)).collect()] == ["Rules", "Known [v2]", "vision v:3b [v1]"]
    assert spark.range(1).select(sets.record_id(F.lit("test"), F.lit(7)), sets.split_alias(F.lit("dev"))).first()[:] == ("test_007", "validation")


def test_monitoring(spark):
    rows = [("m", 1.0, 3.0, 10, 5, "length"), ("m", None, 1.0, 20, None, "stop"), ("m", 3.0, 4.0, None, 7, None)]
    df = spark.createDataFrame(rows, "mode string, t_ocr double, t_llm double, prompt_tokens int, completion_tokens int, done_reason string")
    r = monitor.run_stats(df, "mode").first()
    assert (r.ocr_p50, r.total_p50, r.truncated, r.prompt_tokens_mean) == (1.0, 4.0, 1, 15.0) and r.per_minute == pytest.approx(60 / 4) and r.ocr_p95 == pytest.approx(2.8)
    t = spark.createDataFrame([(1, "a", "app", 1.0, "auto_approve"), (2, None, "eval", 2.0, "review"), (3, "a", "app", float("nan"), "review")], "id long, mode string, source string, t_total double, decision string")
    assert monitor.group_report(t, ("mode",), ("t_total",)).collect()[0][:3] == ("a", 2, 1.0)
    assert [x.id for x in monitor.latest(t, 1, "app").collect()] == [3] and monitor.headline(t).first().auto_approve_pct == pytest.approx(100 / 3)


def test_reviews(spark, tmp_path):
    base = spark.createDataFrame([("r1", 1.0, "a"), ("r2", 2.0, "b")], "review_id string, ts double, receipt string")
    log = review.events(base, "added", F.lit(1)).unionByName(review.events(base.filter("review_id = 'r1'").withColumn("status", F.lit("approved")), "resolved", F.lit(2)))
    log = log.unionByName(review.events(base.filter("review_id = 'r1'").withColumn("status", F.lit("rejected")), "resolved", F.lit(3)))
    now = review.state(log)
    assert {r.review_id: r.status for r in now.collect()} == {"r1": "rejected", "r2": "pending"}
    assert review.by_status(now).first().asDict() == {"pending": 1, "approved": 0, "rejected": 1, "done": 1}
    assert [r.receipt for r in review.not_queued(spark.createDataFrame([("a",), ("c",)], "receipt string"), now).collect()] == ["c"]
    path = str(tmp_path / "traces")
    review.log_traces(spark.createDataFrame([("m", {"a": 1}, 0.5)], "mode string, output map<string,int>, t_total double"), path)
    row = spark.read.parquet(path).first()
    assert json.loads(row.output) == {"a": 1} and row.ts > 0 and row.mode == "m" and row.error is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": i, "ts": 6000 + 60.0 * i, "mode": "m", "t_total": float(i)} for i in range(10)] + [{"id": 3, "ts": 6180.0, "mode": "m", "t_total": 3.0}, {"id": 99, "ts": 19000.0, "mode": "m", "t_total": 1.0}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.run_to_table(stream.windowed(stream.trace_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q2 = stream.run_to_table(stream.windowed(stream.trace_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q2.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.n, r.mean) for r in got] == [(5, 2.0), (5, 7.0)]


def test_percentiles_are_exact(spark):
    """Groups with nulls, NaN, ties, one value, none at all, and a null key."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [("big", float(x), float(rng.integers(0, 5))) for x in rng.normal(0, 100, 6000)]
    rows += [("one", 3.5, None), ("none", None, float("nan")), (None, 1.0, 2.0), (None, 2.0, 4.0)] + [("ties", 7.0, 1.0)] * 50 + [("two", -1.0, 1.0), ("two", 9.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    points = {"p50": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}
    got = {r.g: r for r in stats.percentiles(df, ("g",), {"x": F.col("x"), "y": F.col("y")}, points).collect()}
    assert len(got) == 6
    for g, r in got.items():
        for c, k in (("x", 1), ("y", 2)):
            values = [v[k] for v in rows if v[0] == g and v[k] is not None and v[k] == v[k]]
            for p, q in points.items():
                assert r[f"{c}_{p}"] == (pytest.approx(np.quantile(values, q)) if values else None)
    whole = stats.percentiles(df, (), {"x": F.col("x")}, points).first()
    assert whole.x_p95 == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], 0.95))


def test_similar_names_equal_brute_force(spark):
    import random

    from tallymill.functions.lcs import lcs_length
    from tallymill.operators import match

    rng = random.Random(3)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(120)] + ["--", "", "x", "X", None]
    norm = {n: " ".join("".join(c if c.isalnum() else " " for c in n.upper()).split()) for n in names if n is not None}
    want = {(a, b) for a in norm for b in norm if a < b and (norm[a] == norm[b] or 2 * lcs_length(norm[a], norm[b]) >= 0.6 * (len(norm[a]) + len(norm[b])))}
    got = match.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.6).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_full_width_and_presence(spark, column):
    from tallymill.functions import amounts, names
    from tallymill.operators import ingest

    assert column(amounts.parse_amount, ["￥１，２３４．５０", "（５，０００）", "１２", "Ｒｐ ３９．６００"]) == [1234.5, -5000.0, 12.0, 39600.0]
    assert column(names.norm_name, ["Ｊ．ｓｔｂ　ｐｒｏｍｏ"]) == ["J STB PROMO"]
    trees = ['{"menu":{"nm":"a","price":"5","itemsubtotal":"abc"}}', '{"menu":{"nm":"a","price":"5","itemsubtotal":null}}', '{"menu":{"nm":"a","price":"5","itemsubtotal":"9","unitprice":"x"}}', '{"menu":{"nm":"a","price":"5","itemsubtotal":[]}}']
    items = [r.gold["items"][0] for r in ingest.with_tree_record(spark.createDataFrame(list(enumerate(trees)), "i int, raw string")).orderBy("i").collect()]
    assert [(x.unit_price, x.line_total) for x in items] == [(5.0, None), (None, 5.0), (None, 9.0), (5.0, None)]


def test_settings_reach_the_rules(spark):
    from tallymill.config import Settings
    from tallymill.operators import validate
    from tallymill.types import RECEIPT

    row = ("s", [("a", None, None, 98.0)], 100.0, None, None, None, 100.0, None)
    df = spark.createDataFrame([(row,)], f"receipt {RECEIPT}")
    decide = lambda **k: validate.with_settings(df, Settings(**k)).first().decision
    assert decide() == "review" and decide(abs_tol=2.0) == "auto_approve" and decide(abs_tol=2.0, approve_threshold=1.5) == "review"


def test_review_list_and_trace_ids(spark, tmp_path):
    from tallymill.operators import monitor, review

    path = str(tmp_path / "traces")
    for k in range(3):
        review.log_traces(spark.createDataFrame([(f"m{k}",)] * 5, "mode string").repartition(3), path)
    rows = spark.read.parquet(path)
    assert rows.select("id").distinct().count() == 15 and {r.mode for r in monitor.latest(rows, 5).collect()} == {"m2"}
    assert monitor.look_up(rows, rows.first().id).count() == 1
    log = spark.createDataFrame([("b", 2, "added", None), ("a", 5, "added", None), ("c", 9, "added", None), ("a", 11, "resolved", "approved")], "review_id string, seq long, kind string, status string")
    full = review.events(log.filter("kind = 'added'"), "added", F.col("seq")).unionByName(review.events(log.filter("kind = 'resolved'"), "resolved", F.col("seq")))
    state = review.state(full)
    assert [r.review_id for r in review.listed(state).collect()] == ["b", "a", "c"] and [r.review_id for r in review.listed(state, "pending").collect()] == ["b", "c"]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_similar_names_build_few_pairs_and_lose_none(spark, least):
    import random

    from tallymill.functions.lcs import lcs_length
    from tallymill.operators import match

    r = random.Random(7)
    stems = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 13))) for _ in range(150)]
    names = {"", "a", "aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaab", "日本", "x" * 90, "x" * 88 + "yz", *stems}
    for w in stems:
        k = r.randrange(len(w))
        names |= {w[:k] + r.choice("xyz ") + w[k + 1 :], w[:k] + w[k + 1 :], w[::-1]}
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string")
    norm = {n: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in n.upper()).split()) for n in names}
    sim = lambda a, b: 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0
    want = {(a, b): s for i, a in enumerate(names) for b in names[i + 1 :] if (s := sim(norm[a], norm[b])) >= least}
    got = {(x.a, x.b): x.sim for x in match.similar_names(df, least).collect()}
    assert got == pytest.approx(want)
    built, every = match.candidate_names(df, least).count(), len(names) * (len(names) - 1) // 2
    assert built < {0.6: 0.35, 0.8: 0.05, 0.9: 0.02}[least] * every, (built, every, len(want))


def test_words_meet_only_where_they_are_alike(spark):
    """Words of the same letters in another order do not meet, however many there are; long ones and empty ones are found as well."""
    import itertools
    import random

    from tallymill.functions.lcs import lcs_length
    from tallymill.operators import match

    rnd = random.Random(3)
    words = {"".join(rnd.choices("ABCDE", k=rnd.choice((0, 9, 10, 11, 12, 20, 30)))) for _ in range(400)}
    words |= {w[:4] + w[5:] for w in list(words)[:200]} | {w.lower() for w in list(words)[:20]}
    names = sorted(words)
    up = [w.upper() for w in names]
    want = {(a, b): 2 * lcs_length(x, y) / (len(x) + len(y) or 1) for (a, x), (b, y) in itertools.combinations(zip(names, up, strict=True), 2) if x == y or 2 * lcs_length(x, y) >= 0.9 * (len(x) + len(y)) - 1e-12}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.a, x.b): x.sim for x in match.similar_names(df, 0.9).collect()}
    assert got.keys() == want.keys()
    short = {p for p in want if max(map(len, p)) < match.unshortened_from(0.9)}
    met = [(x.a, x.b) for x in match.candidate_names(df.filter("length(name) < 18"), 0.9).collect()]
    assert sorted(met) == sorted(short)


def test_flagged_rows_join_each_key_once(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    others = spark.createDataFrame([(1,)] * 50 + [(None,), (3,)], "id long")
    found = sets.with_flag(rows, others, "id", "there")
    assert sorted((r.id or 0, r.there) for r in found.collect()) == [(0, False), (1, True), (1, True), (2, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate [id" in plan
