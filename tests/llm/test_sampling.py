"""Periodic runs, mixing and importance resampling against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import crc, importance, mixing, periodic, tandem
from tallymill.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, source string"
AWKWARD = [(900, None, None), (901, "", ""), (902, "  \n\t ", "é"), (903, "a", "z"), (904, "ab " * 4000, None), (905, "x" * 100_000, "s"), (905, "ein zwei drei " * 30, "s"), (905, "ein zwei drei " * 30, "s"), (None, "A b\x0bA b\x0cA b\xa0 " * 12, "s")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def real(spark, n=60):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(n).collect()]
    return [r for r in rows if len(r[1] or "") < 6000] + AWKWARD


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with awkward and real documents, and columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("sampling"))
    docs = spark.createDataFrame(real(spark), DOCS).withColumns({"row": F.lit(1), "rank": F.lit("r"), "place": F.lit(2), "key": F.lit(3), "size": F.lit(4), "runs": F.lit(5), "__part": F.lit(6)})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for d in (folder, f"{folder}/none"):
        table(spark, SF, "benchmark").write.parquet(f"{d}/benchmark.parquet")
    return folder


# ---------------------------------------------------------------- periodic runs


def brute_runs(x, least=2, times=2):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(x[i : j + q - d] == x[i + d : j + q] for d in range(1, q)):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_random_words():
    r = random.Random(5)
    for _ in range(1500):
        k, n = r.choice([1, 2, 2, 3, 4]), r.randrange(40)
        x = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.4:
            a = r.randrange(n)
            p = 1 + r.randrange((n - a) // 2 + 1)
            x = x[:a] + [x[a + (i - a) % min(p, n - a)] for i in range(a, n)] + x[: r.randrange(5)]
        assert [tuple(t) for t in tandem.runs(np.asarray(x, np.int64)).tolist()] == brute_runs(x), x


def test_runs_of_fibonacci_and_one_letter():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert [tuple(t) for t in tandem.runs(np.asarray(b[:400])).tolist()] == brute_runs(b[:400])
    assert tandem.runs(np.zeros(5000, np.int64)).tolist() == [[0, 5000, 1]]


def expected_periodic(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 24, 3)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-((r[1] - r[0]) * 10**12 // r[2]), r[0], r[2]), default=None)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_query(spark, corpus):
    got = periodic.op11_periodic_runs(spark, corpus)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected_periodic(d, t) for d, t, _ in real(spark)]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert sum(w[1] for w in want) > 5
    assert periodic.op11_periodic_runs(spark, f"{corpus}/none").count() == 0


def test_planted_runs_with_noise_around(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(300)}"
    rows = []
    for i in range(60):
        text = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(4)):
            q = r.randrange(1, 20)
            unit = [word() for _ in range(q)] if r.random() < 0.7 else [word()] * (q - 1) + [word()]
            text += (unit * 8)[: r.randrange(2 * q, 8 * q)] + [word() for _ in range(r.randrange(12))]
        rows.append((i, " \n".join(text)))
    got = {r["doc_id"]: ([(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = text.split()
        found = brute_runs(words, 24, 3)
        dropped = {k for s, e, q in found for k in range(s + q, e)}
        assert got[i] == (found, " ".join(w for k, w in enumerate(words) if k not in dropped))
    assert sum(len(x[0]) for x in got.values()) > 40


def test_long_document(spark):
    words = [f"w{i % 4099}" for i in range(40_000)]
    (r,) = periodic.collapse(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, 40_000, 4099)] and r["collapsed"] == " ".join(words[:4099])


# ---------------------------------------------------------------- mixing


def in_duckdb(spark, folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return [tuple(r) for r in con.execute(sql).fetchall()]


def test_mixing_query(spark, corpus):
    got = mixing.op12_mixing(spark, corpus)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = [tuple(r) for r in got.collect()]
    want = in_duckdb(spark, corpus, mixing.SQL)
    # the two rows of one id and text may swap what they give
    total = lambda rows: collections.Counter({k: sum(r[4] for r in rows if r[:4] == k) for k in {r[:4] for r in rows}})
    assert collections.Counter(r[:4] for r in rows) == collections.Counter(r[:4] for r in want) and total(rows) == total(want)
    assert mixing.op12_mixing(spark, f"{corpus}/none").count() == 0


def rounds(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else share * weights[i]
        open_ = open_ - over if over else set()
    return out


@pytest.mark.parametrize("sizes", [[5, 100, 1000, 3, 7, 9000], [0, 0], [1], [10] * 7, [0, 4, 100000, 2, 2, 2, 50]])
def test_targets_equal_the_rounds(spark, sizes):
    got = mixing.targets(spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")).orderBy("place").collect()
    want = rounds(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [r["target"] for r in got] == pytest.approx(want)


def test_mix_is_exact_disjoint_and_repeats(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 300)), r.choice(["a"] * 6 + ["b", "c", "d", "e", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, block=32, shard_words=4000).collect()
    targets = {x["source"]: x["target"] for x in mixing.plan(docs)[1].collect()}
    taken, size = collections.Counter(), {i: len(t.split()) for i, t, _ in rows}
    per_doc, seen, shards = collections.Counter(), set(), collections.defaultdict(list)
    for x in got:
        taken[x["source"]] += x["words"]
        per_doc[x["doc_id"]] += x["words"]
        assert (x["doc_id"], x["start"], x["epoch"]) not in seen and x["start"] + x["words"] <= size[x["doc_id"]]
        seen.add((x["doc_id"], x["start"], x["epoch"]))
        shards[x["shard"]].append(x)
    assert taken == {s: math.floor(t + 0.5) for s, t in targets.items() if math.floor(t + 0.5)}
    assert all(n <= 3 * size[i] for i, n in per_doc.items())
    assert len(shards) == 16 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(x["position"] for x in xs) == list(range(len(xs))) for xs in shards.values())
    # each source's draws in a shard are one stretch of its order
    for xs in shards.values():
        by = collections.defaultdict(list)
        for x in xs:
            by[x["source"]].append(x["draw"])
        assert all(max(d) - min(d) + 1 == len(d) for d in by.values())


def test_mixing_agrees_however_rows_lie(spark):
    docs = table(spark, SF, "documents")
    one, two = (collections.Counter(map(tuple, mixing.mix_counts(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_hypergeometric_draws(spark):
    """The shares of 20,000 draws are those of the distribution; sums and bounds hold."""
    for good, bad, n in ((10, 15, 8), (3, 500, 100), (40, 2, 30)):
        u = (F.col("id") + 0.5) / 20_000.0
        got = collections.Counter(r[0] for r in spark.range(20_000).select(mixing.hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(n).cast("long"), u)).collect())
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if n - k <= bad else 0
            assert abs(got[k] / 20_000 - p) < 2e-4, (good, bad, n, k)


def test_tree_keeps_quotas(spark):
    quotas = [1000, 0, 37, 1, 250_000]
    got = mixing.split_quotas(spark.createDataFrame(list(enumerate(quotas)), "place int, quota long"), 5).collect()
    sums, shards = collections.Counter(), collections.Counter()
    for r in got:
        sums[r["place"]] += r["quota"]
        shards[r["shard"]] += r["quota"]
    assert [sums[i] for i in range(5)] == quotas and len(shards) == 32 and max(shards.values()) - min(shards.values()) <= 1
    big = [r["quota"] for r in got if r["place"] == 0]
    assert len(set(big)) > 5 and abs(np.mean(big) - 1000 / 32) < 1e-9


# ---------------------------------------------------------------- importance resampling


def test_crc_of_joined_words():
    words = [b"a", b"bc", b"x" * 63, b"y" * 64, b"z" * 1000, "é".encode(), b"q" * 129, b"r" * 70_000]
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.asarray([len(w) for w in words])
    doc = np.asarray([0, 0, 0, 0, 0, 1, 1, 2])
    got = crc.word_run_crcs(data, np.cumsum(length) - length, length, doc, 3)
    for k, (c, d) in enumerate(got, 1):
        want = [(zlib.crc32(b" ".join(words[i : i + k])), doc[i]) for i in range(len(words) - k + 1) if doc[i] == doc[i + k - 1]]
        assert list(zip(c.tolist(), d.tolist(), strict=True)) == want


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_importance_query(spark, corpus):
    got = importance.op13_importance(spark, corpus)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = [(d, *features(t)) for d, t, _ in real(spark)]
    s = collections.Counter(b for _, _, f in rows for b in f)
    t = collections.Counter(b for r in table(spark, corpus, "benchmark").collect() for b in features(r["text"])[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    want = []
    for d, n, f in rows:
        w = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = {id(x): k for k, x in enumerate(able[: 5 * len(able) // 100], 1)}
    assert drawn
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((*x[:4], drawn.get(id(x))) for x in want)
    assert importance.op13_importance(spark, f"{corpus}/none").count() == 0


def test_matrix_blocks_come_back(spark):
    docs = spark.createDataFrame(real(spark), DOCS)
    matrix = importance.blocks(docs)
    sums = importance.column_sums(matrix)
    want = collections.Counter(b for _, t, _ in real(spark) for b in features(t)[1])
    assert {i: n for i, n in enumerate(sums.tolist()) if n} == want


def test_importance_reads_blocks_few_at_a_time(spark, monkeypatch):
    """A stored block may have a megabyte and the reader decodes as many rows at once as it is told: not thousands."""
    from tallymill.llm import common, importance

    size, before, seen, keep = "spark.sql.parquet.columnarReaderBatchSize", spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"), {}, common.keep
    monkeypatch.setattr(common, "keep", lambda df, label, **options: seen.update({label: (spark.conf.get(size), options)}) or keep(df, label, **options))
    docs = spark.createDataFrame([(i, f"word{i % 7} and some more words of text {i}") for i in range(50)], "doc_id long, text string")
    assert importance.resample(docs, docs.select("text")).count() == 50
    assert int(seen["scores"][0]) <= 8
    assert int(seen["csr"][1]["parquet.block.size"]) <= 16 << 20
    assert spark.conf.get(size) == before
