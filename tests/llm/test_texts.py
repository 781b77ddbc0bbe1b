"""Operators that judge each text by itself: URL filter, packing, language, tokens, toxicity."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import language_id as lang
from tallymill.llm import packing, token_count, toxicity
from tallymill.llm import url_filter as url

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- URL filter

URLS = {
    "https://Www.EXAMPLE.com/en/7x?q=1": ("www.example.com", "/en/7x", "example.com/en/7", "allow"),
    "http://other.com/en/1#x": ("other.com", "/en/1", "com/en/", "block"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"),
    "http://notcom/en/": ("notcom", "/en/", None, None),
    "a://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
    "a://y.example.net/de/8": ("y.example.net", "/de/8", "example.net/de/8", "block"),
    "https://q.org?x=/es/": ("q.org", "", None, None),
    "https://q.org/es/": ("q.org", "/es/", "org/es/", "block"),
    "ftp://h/p://q": ("h", "/p://q", None, None),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def pages(spark, urls):
    html = "<html><script>junk</script><p>spam farm casino news word words the river stone</p></html>"
    return spark.createDataFrame([(i, u, html, 5) for i, u in enumerate(urls)], "page_id long, url string, html string, verdict int")


def test_url_rules_and_parts(spark):
    rows = {r.page_id: r for r in url.url_filter(pages(spark, URLS)).collect()}
    assert len(rows) == len(URLS)
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert url.url_filter(pages(spark, ["x://a"]).limit(0)).count() == 0


def test_segmentation_and_bayes():
    lex = url.Lexicon.of({"spam": 50, "farm": 40, "river": 30, "stone": 20, "riv": 1})
    assert lex.segment("spamfarm") == ["spam", "farm"] and lex.segment("riverstonespam") == ["river", "stone", "spam"] and lex.segment("") == []

    def brute(s):
        if not s:
            return 0.0
        return max((lex.logp.get(s[:i], lex.unknown - 2.5 * (i - 1))) + brute(s[i:]) for i in range(1, len(s) + 1))

    for word in ("spamriv", "xfarmx", "stoner"):
        assert sum(lex.logp.get(w, lex.unknown - 2.5 * (len(w) - 1)) for w in lex.segment(word)) == pytest.approx(brute(word))
    counts = np.zeros((2, url.BUCKETS))
    counts[1, url.bucket("spam")] += 9
    counts[0, url.bucket("river")] += 9
    nb = url.NaiveBayes.of(counts)
    assert nb.score(["spam"]) == pytest.approx(np.log(10 / 1) ) and nb.score(["river", "unseen"]) < 0 < nb.score(["spam", "unseen"])


def taught(spark, extra=()):
    """Pages whose hosts the rules block or allow, by words that the rules do not name, and pages without a rule."""
    rng = random.Random(3)
    bad, good = ("casino", "spam", "farm", "poker"), ("museum", "news", "river", "stone")
    urls = [f"http://{rng.choice(bad)}{rng.choice(bad)}.h{i}.com/en/{rng.choice(bad)}" for i in range(60)]
    urls += [f"http://{rng.choice(good)}{rng.choice(good)}.h{i}.net/de/{rng.choice(good)}" for i in range(60)]
    html = "<html><script>junk</script><p>" + " ".join((*bad, *good, "the", "word", "words")) + "</p></html>"
    all_ = [*urls, *extra]
    return spark.createDataFrame([(i, u, html, 5) for i, u in enumerate([*all_, all_[0]])], "page_id long, url string, html string, verdict int")


def test_url_verdicts_equal_a_recount(spark):
    """Lexicon, model and verdicts counted again in plain Python."""
    extra = ["http://pokerspam.xyz/a", "http://museumstone.org/fr/1", "http://a.com/fr/x", "http://x.org/en/a", "http://casinonews.xyz/", None]
    df = taught(spark, extra)
    rows = df.collect()
    count = {}
    for r in rows:
        for w in "".join(c if c.isalpha() else " " for c in r.html.replace("<html><script>junk</script><p>", "").replace("</p></html>", "")).split():
            count[w] = count.get(w, 0) + 1
    base = max(10, sum(count.values()) // 2000)
    for w in url.HOST_WORDS:
        count[w] = max(count.get(w, 0), base)
    lex = url.Lexicon.of(count)
    words = lambda part: ["#"] if part == "#" else lex.segment(part)
    toks = lambda h, p: [w for x in url.host_parts(h) for w in words(x)] + [f"/{w}" for x in url.path_parts(p) for w in words(x)]
    got = url.url_filter(df).collect()
    assert len(got) == len(rows)
    seen, urls = [], collections.Counter()
    for host, path, rule, verdict in {(r.host, r.path, r.rule, r.verdict) for r in got if r.rule and zlib.crc32(r.host.encode()) % 5}:
        end, start = rule.split("/", 1)
        seen += [(verdict, t) for t in toks(host[: -len(end)], path[len(start) + 1 :])]
        urls[verdict] += 1
    n = collections.Counter(seen)
    prior = math.log((urls["block"] + 1) / (urls["allow"] + 1))
    vocab, total = {t for _, t in n}, {v: sum(c for (w, _), c in n.items() if w == v) for v in ("allow", "block")}
    odds = lambda t: math.log((n.get(("block", t), 0) + 1) / (total["block"] + len(vocab))) - math.log((n.get(("allow", t), 0) + 1) / (total["allow"] + len(vocab)))
    assert len({url.bucket(t) for t in vocab}) == len(vocab)
    for r in got:
        mine = toks(r.host, r.path)
        want = prior + sum(odds(t) for t in mine if t in vocab) if mine else 0.0
        assert r.score == pytest.approx(want) and r.method == ("block" if want > math.log(url.EVIDENCE) else "allow") and r.held_out == (zlib.crc32(r.host.encode()) % 5 == 0)
        assert r.verdict == (r.method if r.rule is None else "block" if r.rule == "com/en/" else "allow")
    by = {r.page_id: r for r in got}
    assert [by[120 + k].verdict for k in range(6)] == ["block", "allow", "allow", "allow", "allow", "allow"]  # no echo of com, org or /en
    held = [r for r in got if r.rule and r.held_out]
    assert len(held) > 10 and all((r.method == "block") == (r.rule == "com/en/") for r in held)


def test_url_learns_from_given_labels(spark):
    labelled = spark.createDataFrame([(f"http://{w}.q{i}.xyz/", v) for i in range(20) for w, v in (("river", "block"), ("casino", "allow"))], "url string, verdict string")
    rows = {r.page_id: r for r in url.url_filter(taught(spark, ["http://riverriver.xyz/", "http://casino.xyz/"]), labelled=labelled).collect()}
    assert (rows[120].verdict, rows[121].verdict) == ("block", "allow") and rows[0].verdict == "block" and rows[0].method == "allow"


def test_url_words_count_however_many_there_are(spark):
    """25,000 words of like frequency and a word of 24 letters, all known to the segmentation."""
    words = ["".join("bcdfghjklm"[int(d)] + "aeiou"[int(d) % 5] for d in f"{i:05d}") for i in range(25_000)]
    rare = "counterrevolutionariesxx"
    html = spark.createDataFrame([(0, f"http://{words[7]}{words[24_999]}.xyz/{words[12_345]}", " ".join([*words, rare])), (1, f"http://{words[3]}{rare}.xyz/", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in url.url_filter(html).collect()}
    assert rows[0].words == f"{words[7]} {words[24_999]} xyz" and rows[1].words == f"{words[3]} {rare} xyz"


def test_url_parts_of_any_length(spark):
    """100,000 letters without a break beside short names: split whole, in bounded pieces."""
    long = "casinoriver" * 600 + "q" * 93_400
    rows = {r.page_id: r for r in url.url_filter(pages(spark, [f"http://{long}.xyz/a", "http://casinoriver.xyz/", f"http://b.xyz/{'x' * 6500}"])).collect()}
    assert rows[0].words.startswith("casino river " * 600 + "q") and rows[0].words.endswith(" xyz") and rows[0].words.replace(" ", "") == long + "xyz"
    assert rows[1].words == "casino river xyz" and rows[2].verdict == "allow"


def test_url_hosts_with_digits_give_words(spark):
    rows = {r.page_id: r for r in url.url_filter(pages(spark, ["http://casino24.xyz/a", "http://best4poker.xyz/a", "http://museum7news.xyz/a"])).collect()}
    assert rows[0].words == "casino # xyz" and rows[1].words.endswith("# poker xyz") and rows[2].words == "museum # news xyz"


def test_url_repeated_rows_are_judged_each(spark):
    df = pages(spark, URLS).withColumns({"host": F.lit("clash"), "part": F.lit("clash")})
    rows = url.url_filter(df.union(df)).collect()
    assert len(rows) == 2 * len(URLS) and len({tuple(r) for r in rows}) == len({r.page_id for r in rows}) == len(URLS)


# ---------------------------------------------------------------- packing

TEXTS = ["", None, "Hello world", "x" * 9000, "a <|endoftext|> b", "naïve Straße 日本語 😀", "  spaces \n\n tabs\t", "I'll we've 123 456", "dup dup"] + ["word " * n for n in (1, 700, 1022, 1023, 1024, 5000)] + ["same text"] * 40


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in enumerate(TEXTS)}
    rows = packing.pack(docs(spark, TEXTS).withColumn("key", F.lit("clash")), path).collect()
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(want)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r.length
        assert at <= 1024 and at & at - 1 == 0  # never padded
    assert packing.pack(docs(spark, ["a"]).limit(0), path).count() == 0


def test_repeated_rows_are_packed_each(spark):
    d = docs(spark, ["one two"])
    rows = packing.pack(d.union(d), tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens


def test_wide_ids_travel_in_four_bytes():
    from types import SimpleNamespace

    assert [packing.id_bytes(SimpleNamespace(n_vocab=n)) for n in (50_257, 1 << 16, (1 << 16) + 1, 200_000)] == [2, 2, 4, 4]


def test_hilbert_is_a_curve():
    side = 16
    grid = np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), -1).reshape(-1, 2)
    key = packing.hilbert((grid + 0.5) / side, 4)
    order = np.argsort(key)
    assert sorted(key) == list(range(side * side)) and (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


# ---------------------------------------------------------------- token counts


def test_token_counts_of_long_texts_without_spaces(spark):
    """Megabytes in one piece are counted, and not remembered."""
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["abcd" * 200_000, "é" * 300_000 + " x", "a" * 64, "a" * 65] * 2
    got = {r.doc_id: r.n_tokens for r in token_count.token_count(docs(spark, texts), path).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in lib.encode(texts, num_threads=1)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = ["a", "b", "the", "  ", " ", "\n", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "é", "日", "😀", "\x00", "aaaa", "====", "ing", "tion", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None, " ", "a" * 3000, "ab" * 2000, " " * 500, "long text " * 3000]
    rows = {r.doc_id: r for r in token_count.token_count(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_count.token_count(docs(spark, ["a"]).limit(0), path).count() == 0


def test_token_counts_of_repeated_rows_and_clashing_columns(spark):
    d = docs(spark, ["one two", None, "x " * 5000]).withColumns({c: F.lit("clash") for c in ("n_tokens", "n_bytes", "over_limit")})
    rows = token_count.token_count(d.union(d), tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 6 and len({(r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) for r in rows}) == 3
    assert {r.doc_id for r in rows if r.over_limit} == {2} and {r.n_tokens for r in rows if r.doc_id == 1} == {0}


# ---------------------------------------------------------------- language

VOCAB = {
    "en": "the of and to that with for from which have this river stone people water between".split(),
    "de": "der die und ist nicht mit für auf eine auch werden wasser zwischen menschen schön".split(),
    "fr": "le la les des est dans pour que avec une eau entre été où personnes très".split(),
}


def speech(rng, name, n=60):
    return " ".join(rng.choice(VOCAB[name]) for _ in range(n))


def labelled(spark, n=40):
    rng = random.Random(5)
    rows = [(i, speech(rng, name), name, "s", 1) for i, name in enumerate([*VOCAB] * n)]
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "123 !!", None, "s", 1), (1003, speech(rng, "de", 4000), None, "s", 1), (1003, speech(rng, "fr"), None, "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "rejected": F.lit(1)})


def test_language_held_out(spark):
    d = labelled(spark)
    rows = lang.identify(d, lang.train(d)).join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and r.text]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in rows if r.doc_id in (1000, 1001, 1002)}
    assert {r.lang_pred for r in odd.values()} == {"und"} and all(r.score == 0 and r.rejected for r in odd.values())
    assert {r.lang_pred for r in rows if r.doc_id == 1003} == {"de", "fr"}


def test_language_equals_brute_force(spark):
    """TF-IDF, spherical k-means and cosines in plain Python dictionaries."""
    d = labelled(spark, 8)
    rows = d.collect()
    vec = lambda t: {j: float(x) for j, x in enumerate(lang.counts(pa.array([t]))[0]) if x}
    fit = sorted((r.lang, str(r.doc_id), r.text) for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5)
    df = {}
    for _, _, t in fit:
        for j in vec(t):
            df[j] = df.get(j, 0) + 1
    idf = {j: math.log((1 + len(fit)) / (1 + df.get(j, 0))) + 1 for j in range(1 << lang.BITS)}
    unit = lambda v: {j: x / (sum(y * y for y in v.values()) ** 0.5 or 1) for j, x in v.items()}
    tfidf = lambda t: unit({j: math.log1p(x) * idf[j] for j, x in vec(t).items()})
    cos = lambda a, b: sum(x * b.get(j, 0) for j, x in a.items())
    mean = lambda vs: unit({j: sum(v.get(j, 0) for v in vs) / len(vs) for j in {j for v in vs for j in v}})
    centres = []
    for name in sorted({x[0] for x in fit}):
        mine = [tfidf(t) for x, _, t in fit if x == name and t]
        c = [mean(mine)]
        while len(c) < min(lang.CENTROIDS, len(mine)):
            c.append(min(mine, key=lambda v: max(cos(v, x) for x in c)))  # noqa: B023
        for _ in range(lang.ROUNDS):
            near = [max(range(len(c)), key=lambda j: cos(v, c[j])) for v in mine]  # noqa: B023
            c = [mean([v for v, n in zip(mine, near, strict=True) if n == j]) if j in near else c[j] for j in range(len(c))]
        near = [max(range(len(c)), key=lambda j: cos(v, c[j])) for v in mine]  # noqa: B023
        centres += [(name, x) for j, x in enumerate(c) if j in near]
    got = {(r.doc_id, round(r.score, 3), r.lang_pred) for r in lang.identify(d, lang.train(d)).collect() if r.lang_pred != "und"}
    want = set()
    for r in rows:
        if r.text and any(ch.isalpha() for ch in r.text):
            name, best = max(((n, cos(tfidf(r.text), x)) for n, x in centres), key=lambda x: x[1])
            want.add((r.doc_id, round(best, 3), name))
    assert {x[::2] for x in got} == {x[::2] for x in want}
    for (i, s, n), (i2, s2, n2) in zip(sorted(got), sorted(want), strict=True):
        assert (i, n) == (i2, n2) and abs(s - s2) <= 0.0021


def test_languages_are_not_capped(spark):
    rows = [(10 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 30, f"l{k:03d}", "s", 1) for k in range(540) for j in range(4)]
    d = spark.createDataFrame(rows, DOCS)
    assert len(set(lang.train(d).langs)) > 530


def test_language_rejects_what_is_far(spark):
    d = labelled(spark)
    far = docs(spark, ["zzqx qxzz xqzz " * 20], None)
    assert lang.identify(far, lang.train(d)).first().rejected and lang.identify(far, lang.train(d), reject_to_und=True).first().lang_pred == "und"
    assert lang.train(d.limit(0)) is None and {r.lang_pred for r in lang.identify(far, None).collect()} == {"und"} and lang.identify(far.limit(0), None).count() == 0


# ---------------------------------------------------------------- toxicity


def judged(spark, n=400):
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in ("ri", "sto", "wa", "pe") for b in ("ver", "ne", "ter", "ople", "land")]
    bad = ["horrible", "stupidest", "worthless"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows, DOCS).withColumn("predicted", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_misspelt(spark):
    d, labels = judged(spark)
    model = toxicity.train(d, labels)
    rows = [r for r in toxicity.score(d, model).join(labels, "doc_id").collect() if r.held_out]
    assert rows and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    plain = "river stone water people riland " * 12
    s = model.score(pa.array([plain + "worthlesss stupidestt horriblee worthlesz", plain, "", None]))
    assert s[0] > s[1] and s[2] == s[3] and ((0 <= s) & (s <= 1)).all()
    kept = toxicity.filter_docs(d, model)
    assert kept.columns == d.columns and kept.count() == toxicity.score(d, model).filter("predicted = 0").count()


def bags_of(texts):
    parts = [np.unique(toxicity.bags(pa.array([t]))[0], return_counts=True) for t in texts]
    total = np.asarray([n.sum() for _, n in parts])
    return parts, toxicity.Bags.of(np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts]), np.asarray([len(i) for i, _ in parts]), total)


def test_toxicity_step_equals_brute_force(monkeypatch):
    """Both layers after two joint steps of Adam, by loops over the definition."""
    monkeypatch.setattr(toxicity, "STEPS", 2)
    monkeypatch.setattr(toxicity, "BATCH", 4)
    parts, every = bags_of(["horrible river", "stone water stone", "worthless land"])
    weight, shift = toxicity.descend(every, np.asarray([1, 0, 1, 0]), np.arange(4))
    rng = np.random.default_rng(7)
    emb, out, bias = rng.normal(0, 0.1, (1 << toxicity.BITS, toxicity.DIM)), rng.normal(0, 0.3, (toxicity.DIM, 2)), np.zeros(2)
    bags = [{int(i): n / (ns.sum() + toxicity.NEUTRAL) for i, n in zip(ids, ns, strict=True)} for ids, ns in parts] + [{}]
    y, moments, step = [1, 0, 1, 0], {}, 0
    for epoch in range(2):
        g_emb, g_out, g_bias = {i: toxicity.DECAY * emb[i] for b in bags for i in b}, np.zeros_like(out), np.zeros(2)
        for b, label in zip(bags, y, strict=True):
            h = sum((emb[i] * x for i, x in b.items()), np.zeros(toxicity.DIM))
            p = np.exp(h @ out + bias)
            p = p / p.sum()
            p[label] -= 1
            p /= 4
            g_out += np.outer(h, p)
            g_bias += p
            for i, x in b.items():
                g_emb[i] = g_emb[i] + x * (out @ p)
        step += 1
        rate = toxicity.RATE * (1 - step / 3)

        def adam(key, value, grad):
            m, v = moments.get(key, (0, 0))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad  # noqa: B023
            moments[key] = m, v
            return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)  # noqa: B023

        for i, g in g_emb.items():
            emb[i] = adam(i, emb[i], g)
        out, bias = adam("out", out, g_out), adam("bias", bias, g_bias)
    used = sorted({i for b in bags for i in b})
    assert np.allclose(weight[used], (emb @ (out[:, 1] - out[:, 0]))[used], atol=5e-3) and shift == pytest.approx(bias[1] - bias[0], abs=2e-3)


def test_toxicity_cut_is_the_best_of_unseen_scores():
    z, y = np.asarray([3.0, 2.0, 1.0, 0.0, -1.0]), np.asarray([1, 0, 1, 0, 0])
    assert toxicity.best_cut(z, y) == 0.5 and toxicity.best_cut(z, y * 0) == 4.0 and toxicity.best_cut(z, y * 0 + 1) == -2.0


def test_toxicity_scores_equal_brute_force(spark):
    """Whole scores, of one task's model: folds, cut and averages by loops."""
    d, labels = judged(spark, 60)
    model = toxicity.train(d, labels)
    known = sorted((str(r.doc_id), int(r.toxic), r.text) for r in d.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic in (0, 1))
    _, every = bags_of([t for *_, t in known])
    y = np.asarray([t for _, t, _ in known] + [0] * (len(every.size) - len(known)))
    start, unseen = np.cumsum(every.size) - every.size, {}
    score = lambda i, weight, bias: bias + sum(float(weight[every.bucket[k]]) * float(every.share[k]) for k in range(start[i], start[i] + every.size[i]))
    for f in range(toxicity.FOLDS):
        weight, bias = toxicity.descend(every, y, np.asarray([i for i in range(len(y)) if i % toxicity.FOLDS != f]))
        unseen |= {i: score(i, weight, bias) for i in range(len(y)) if i % toxicity.FOLDS == f}
    f1 = lambda cut: 2 * sum(y[i] for i in unseen if unseen[i] > cut) / (sum(unseen[i] > cut for i in unseen) + sum(y))
    weight, bias = toxicity.descend(every, y, np.arange(len(y)))
    cut = bias - model.bias
    assert f1(cut) == pytest.approx(max(f1(v - 1e-9) for v in unseen.values()))
    for r in toxicity.score(d, model).join(d.select("doc_id", "text"), "doc_id").collect():
        bucket, _ = toxicity.bags(pa.array([r.text]))
        z = sum(float(weight[b]) for b in bucket) / (len(bucket) + toxicity.NEUTRAL) + bias - cut
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_of_long_texts(spark):
    """Words beyond 65,535 repeats count in full; a megabyte of text is scored whole."""
    d, labels = judged(spark, 80)
    long = spark.createDataFrame([(5000, "river " * 70_000, "en", "s", 1, "x"), (5001, "land " * 200_000 + "worthless " * 60_000, "en", "s", 1, "x")], d.schema)
    model = toxicity.train(d.union(long), labels.union(spark.createDataFrame([(5000, 1, 0), (5001, 1, 1)], labels.schema)))
    s = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert 0 <= s[5000] < s[5001] <= 1


def test_toxicity_edges(spark):
    d, labels = judged(spark, 8)
    assert toxicity.train(d, labels.limit(0)) is None
    rows = toxicity.score(d.union(d), None).collect()
    assert len(rows) == 16 and {r.score for r in rows} == {0.0} and toxicity.score(d.limit(0), None).count() == 0 and toxicity.filter_docs(d, None).count() == 8


def test_rare_languages_are_learned_beside_many(spark, monkeypatch):
    """60 languages whose rows pass the bound for all, five of them with eight rows: each is learned and found."""
    monkeypatch.setattr(lang, "TRAIN_ROWS", 600)
    rng = random.Random(4)
    rows, names = [], [f"l{k:02}" for k in range(60)]
    for k, name in enumerate(names):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(12)]
        for _ in range(8 if k % 12 == 0 else 60):
            rows.append((len(rows), " ".join(rng.choices(words, k=30)), name, "s", 1))
    known = spark.createDataFrame(rows, DOCS)
    model = lang.train(known)
    assert set(model.langs) == set(names)
    got = lang.identify(known, model).join(known.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got) > 400
