"""Operators that compare texts: suffix arrays, exact, near and chunk dedup, decontamination."""

import collections
import hashlib
import itertools
import pathlib
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill import store
from tallymill.llm import chunk_dedup, common, components, exact_dedup, near_dedup, suffix_dedup
from tallymill.llm import decontamination as dec
from tallymill.llm.shingles import WIDTH, weighted
from tallymill.llm.suffix_array import Suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("digest", "keep_id", "t1", "hs", "marks", "drop", "band", "class_id", "n", "item_id")})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, repeats in one text, empty and null texts, a long text, a repeated row, a null id."""
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 60)
    rows = [(i, b) for i, b in enumerate(base)]
    rows += [(10 + i, base[0]) for i in range(5)]
    for i in range(8):
        words = base[1].split()
        words[rng.randrange(120)] = "changed"
        rows.append((20 + i, " ".join(words)))
    rows += [(40 + i, prose(rng, 50) + " " + passage + " " + prose(rng, 50)) for i in range(6)]
    rows += [(60, "ab " * 2000), (61, passage + " " + passage), (62, ""), (63, None), (64, ""), (65, "one two"), (66, "One, two!"), (67, "..."), (68, "ümlaut ß 日本 " * 60)]
    rows += [(70, prose(rng, 4000)), (2, base[2]), (None, base[3]), (None, None)]
    return rows


# ---------------------------------------------------------------- suffix arrays


def test_suffix_order_and_repeats():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        strings = [*base, *(rng.choice(base)[rng.randint(0, 5) :] for _ in range(4)), b"a" * rng.randint(0, 40), b"ab" * 20, b""]
        depth = rng.choice([8, 9, 16, 24])
        s = Suffixes(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]), depth)
        heads = [x[i : i + depth] for x in strings for i in range(len(x))]
        assert sorted(s.order.tolist()) == list(range(len(heads))) and all(heads[a] <= heads[b] for a, b in zip(s.order, s.order[1:]))
        count = collections.Counter(h for h in heads if len(h) == depth)
        assert s.repeated().tolist() == [len(h) == depth and count[h] > 1 for h in heads]


def brute_repeats(texts):
    texts = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        starts = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(bytes(b for b, g in zip(t, gone[1:]) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("split", [4096, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(common, "HOT_LEAST", split)
    rows = corpus()
    got = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    key = lambda r: (str(r[0]), r[1:])
    want = [(i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_filter_keeps_columns(spark):
    d = table(spark, corpus())
    out = suffix_dedup.filter_docs(d)
    assert out.columns == d.columns and out.count() == d.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] == "" and texts[70] == dict(corpus())[70] and texts[63] is None
    assert suffix_dedup.suffix_dedup(d.limit(0)).count() == 0


# ---------------------------------------------------------------- exact


def test_exact_dedup(spark):
    rows = corpus()
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_filter_and_hot_groups(spark):
    d = table(spark, [(i, "hot" if i % 3 else f"text {i}") for i in range(3000)])
    out = exact_dedup.filter_docs(d)
    assert out.columns == d.columns and out.count() == 1001 and out.filter("text = 'hot'").first().doc_id == 2999
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


def test_exact_filter_judges_each_row_by_its_text(spark):
    """Rows that share an id, or have none, go or stay by their own text."""
    rows = [(5, "a"), (5, "b"), (9, "a"), (None, "a"), (None, "c"), (None, "c"), (None, None), (4, "")]
    for parts in (1, 2):
        got = exact_dedup.filter_docs(table(spark, rows), parts=parts).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, "b"), (9, "a"), (None, "c"), (None, "c"), (4, "")], key=str)


def test_index_persists_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.exact_dedup(table(spark, [(1, "a"), (5, "a"), (2, "b")]), exact_dedup.DigestIndex(spark, path))
    assert {r.doc_id for r in first.collect() if r.kept} == {5, 2}
    index = exact_dedup.DigestIndex(spark, path)
    assert index.exists()
    spark.sql(f"DROP TABLE {index.name}")  # what a session that knows only the folder has
    second = exact_dedup.exact_dedup(table(spark, [(9, "a"), (10, "c"), (11, "c")]), index)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in second.collect()} == {(9, 5, 1), (10, 11, 2), (11, 11, 2)} and index.read().count() == 3
    again = exact_dedup.exact_dedup(table(spark, [(1, "a"), (5, "a"), (2, "b")]), exact_dedup.DigestIndex(spark, path))
    assert {r.doc_id for r in again.collect() if r.kept} == {5, 2} and index.open().read().count() == 3
    index.drop()
    assert not index.exists() and not (tmp_path / "index").exists()


def test_index_of_another_session(spark, tmp_path):
    """Two processes, one after the other, on one folder."""
    code = """
import sys
sys.path.insert(0, {root!r})
from tallymill.session import local_session
from tallymill.llm.exact_dedup import DigestIndex, exact_dedup
spark = local_session(1, 2, "1g")
docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
print(sorted((r.doc_id, r.kept) for r in exact_dedup(docs, DigestIndex(spark, {path!r})).collect()))
"""
    path = f"file://{tmp_path}/index"
    run = subprocess.run([sys.executable, "-c", code.format(root=str(common.__file__).rsplit("/tallymill/", 1)[0], path=path)], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert "[(1, True), (2, True)]" in run.stdout, run.stderr[-2000:]
    got = exact_dedup.exact_dedup(table(spark, [(3, "a"), (4, "c")]), exact_dedup.DigestIndex(spark, path)).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(3, 1, False), (4, 4, True)}
    exact_dedup.DigestIndex(spark, path).drop()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_batches_give_the_result_of_one(spark, parts):
    rows = corpus() + [(500 + i, f"t{i % 7}") for i in range(40)]
    key = lambda r: str(tuple(r))
    one, many = (sorted(exact_dedup.exact_dedup(table(spark, rows), parts=n).collect(), key=key) for n in (1, parts))
    assert one == many and exact_dedup.exact_dedup(table(spark, rows).limit(0), parts=parts).count() == 0


def test_intermediate_tables_are_deleted(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(store.uuid, "uuid4", lambda real=store.uuid.uuid4: folders.append(real()) or folders[-1])
    got = near_dedup.near_dedup(table(spark, corpus()))
    exact_dedup.exact_dedup(table(spark, corpus()), parts=2)
    root = pathlib.Path(store.shared_dir(spark).removeprefix("file:"))
    left = sorted(p.name.rsplit("-", 1)[0] for p in root.iterdir() if p.name[-32:] in {f.hex for f in folders})
    assert got.count() == len(corpus()) and left == ["exact-dedup", "near-dedup"] and len(folders) > 20
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    left = spark.createDataFrame([(i, i % 5 if i < 100 else 0) for i in range(300)], "i long, k long")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k long, v string")
    hot = common.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    key = lambda r: (r.i, r.k, str(r.v))
    for how in ("inner", "left"):
        assert sorted(common.salted_join(left, right, ["k"], hot, ["i"], how).collect(), key=key) == sorted(left.join(right, "k", how).collect(), key=key)
    assert {r.k for r in hot.collect()} == {0, 1, 2, 3, 4} and common.hot_keys(left.limit(0).selectExpr("k", "i AS n"), "k").count() == 0


# ---------------------------------------------------------------- near


def brute_classes(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    doc, h, n = weighted(pa.array([t for _, t in rows]))
    sets = [set(h[doc == k].tolist()) for k in range(len(rows))]
    weight = [dict(zip(h[doc == k].tolist(), (1 + np.log(n[doc == k])).tolist())) for k in range(len(rows))]

    def both(a, b):
        """Weighted similarity by its definition, in sorted prefix sums so that groups of long texts can be compared."""
        x, y = weight[a], weight[b]
        if len(x) + len(y) == len(h[(doc == a) | (doc == b)]) and max(*x.values(), *y.values()) == 1:
            return 0  # weights 1: the set similarity
        shared = sorted(sets[a] & sets[b], key=lambda k: x[k] / y[k])
        up, down, total = sum(x.values()), sum(y[k] for k in sets[b] - sets[a]), 0
        for k in shared:
            up, down = up - x[k], down + y[k]
            total += 1 / (up / x[k] + down / y[k])
        return total
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or both(a, b) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    least = {k: min(v) for k, v in members.items()}
    return {i: least[find(k)] if sets[k] else i for k, (i, _) in enumerate(rows)}


def test_near_dedup_equals_brute_force(spark):
    rows = corpus()
    got = near_dedup.near_dedup(table(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.class_id)
    assert want[66] == 65 and want[27] == want[1] and want[67] == 67
    assert near_dedup.near_dedup(table(spark, rows).limit(0)).count() == 0


def test_near_dedup_finds_links_in_groups_of_almost_similar_texts(spark):
    """A bucket whose members are mostly just under the limit: stars do not connect it, so all open pairs are looked at."""
    rng = random.Random(11)
    base = prose(rng, 150).split()
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(1, 6)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("similar_by", ["sets", "weights"])
def test_near_dedup_finds_near_copies_that_repeat_a_line(spark, similar_by):
    """Set similarity 0.87 or more while a line is repeated in one text only; or a line repeated in both, and too many words changed for the sets."""
    rng = random.Random(17)
    rows = []
    for i in range(60):
        words = prose(rng, 100).split()
        if similar_by == "sets":
            changed = list(words)
            if i % 2:
                changed[80] = "changed"
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed[:30] * (20, 100)[i % 3 > 0] + changed[30:]))]
        else:
            line, rest = words[:60] * 30, words[60:]
            rows += [(2 * i, " ".join(line + rest)), (2 * i + 1, " ".join(line + rest[:10] + prose(rng, 20 - i % 9).split() + rest[30:]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    want = brute_classes(rows)
    assert got == want and sum(want[2 * i + 1] == 2 * i for i in range(60)) >= 40


def test_near_dedup_deals_out_hot_bands(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rng = random.Random(12)
    base = prose(rng, 150).split()
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(1, 6)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words[:40] * (1 + i % 3) + words[40:])))
    rows += [(100 + i, rows[3][1]) for i in range(30)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_share_of_missed_pairs():
    """Pairs of a known similarity share a band as often as the docstring says; similarities just over the limit are nearly always found."""
    rng = np.random.default_rng(8)
    found = {}
    for shared, own in ((80, 10), (67, 17)):
        n = 3000
        common_part, mine = (rng.integers(1, 1 << 62, (n, k)).astype(np.uint64) for k in (shared, 2 * own))
        a, b = np.concatenate([common_part, mine[:, :own]], 1), np.concatenate([common_part, mine[:, own:]], 1)
        keys = [near_dedup.band_keys(near_dedup.probminhash(np.repeat(np.arange(n), shared + own), x.reshape(-1), np.ones(x.size), n)) for x in (a, b)]
        s = shared / (shared + 2 * own)
        found[round(s, 2)] = (keys[0] == keys[1]).any(1).mean()
        assert found[round(s, 2)] == pytest.approx(1 - (1 - s**near_dedup.ROWS) ** near_dedup.BANDS, abs=0.02)
    assert found[0.8] > 0.998


def test_near_filter_keeps_columns(spark):
    d = table(spark, corpus())
    out = near_dedup.filter_docs(d)
    assert out.columns == d.columns and out.filter("doc_id BETWEEN 20 AND 29").count() == 0 and out.filter("doc_id IS NULL").count() == 2


def test_registers_agree_as_often_as_probability_jaccard_says():
    rng = np.random.default_rng(1)
    shared, left, right = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (60, 15, 25))
    a, b = np.sort(np.concatenate([shared, left])), np.sort(np.concatenate([shared, right]))
    wa, wb = 1 + np.log(rng.integers(1, 5, len(a))), 1 + np.log(rng.integers(1, 5, len(b)))
    agree = []
    for salt in range(40):
        s = np.uint64(salt * 2654435761)
        doc = np.repeat([0, 1], [len(a), len(b)])
        reg = near_dedup.probminhash(doc, np.concatenate([a, b]) ^ s, np.concatenate([wa, wb]), 2)
        agree.append((reg[0] == reg[1]).mean())
    _, i, j = np.intersect1d(a, b, return_indices=True)
    slow = sum(1 / sum(max(wa[np.searchsorted(a, k)] / wa[p] if k in set(a.tolist()) else 0, wb[np.searchsorted(b, k)] / wb[q] if k in set(b.tolist()) else 0) for k in np.union1d(a, b)) for p, q in zip(i, j))
    exact = near_dedup.probability_jaccard(a, wa, b, wb)
    assert exact == pytest.approx(slow) and np.mean(agree) == pytest.approx(exact, abs=0.02)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[node] == min(seen)


# ---------------------------------------------------------------- decontamination


def tokens(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def word_grams(t, width):
    w = tokens(t)
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}


def brute_contained(rows, items):
    """(doc_id, item_id) by word n-grams of every item's own width."""
    grams = {width: [(n, word_grams(t, width)) for n, t in rows] for width in range(1, WIDTH + 1)}
    found = set()
    for k, q in items:
        width = min(WIDTH, len(tokens(q)))
        mine = word_grams(q, width) if width else set()
        found |= {(n, k) for n, g in grams.get(width, ()) if len(mine & g) >= 0.8 * len(mine)}
    return found


@pytest.mark.parametrize("hot", [1000, 2])
def test_decontamination_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in enumerate((6, 9, 14, 30, 60, 4, 5))] + [(7, None), (8, ""), (9, "..."), (10, "zebra"), (11, "Two zebras"), (12, "three, more zebras"), (13, prose(rng, 900)), (13, prose(rng, 70)), (None, prose(rng, 40))]
    rows = corpus() + [(100 + k, prose(rng, rng.choice((0, 40, 3000))) + " " + (t or "").upper() + ", " + prose(rng, 40)) for k, (_, t) in enumerate(items)]
    rows += [(200, items[5][1]), (201, " ".join(items[4][1].split()[:50])), (202, " ".join(items[4][1].split()[:40])), (203, "xx two zebras yy"), (203, "zebra"), (204, "two zebras"), (205, "one two three zebra four")]
    d, i = table(spark, rows), spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute_contained(rows, items)
    got = dec.matches(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(200, 5), (201, 4), (203, 11), (203, 10), (204, 11), (205, 10)} <= want and not {(202, 4), (204, 12)} & want
    kept = dec.filter_docs(d, i)
    left = [n for n, t in rows if not brute_contained([(n, t)], items)]
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, left))
    assert dec.matches(d, i.limit(0)).count() == 0 and dec.matches(d.limit(0), i).count() == 0 and dec.filter_docs(d, i.limit(0)).count() == len(rows)


def test_decontamination_takes_any_ids(spark):
    rng = random.Random(6)
    text = prose(rng, 30)
    d = spark.createDataFrame([("x", "aa " + text), (None, text + " bb"), ("y", "bb")], "doc_id string, text string")
    items = spark.createDataFrame([("", text), ("a", "bb")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in dec.matches(d, items).collect()} == {("x", ""), (None, ""), (None, "a"), ("y", "a")} and dec.filter_docs(d, items).count() == 0


def test_sampled_sketches_find_what_is_contained(spark, monkeypatch):
    """Items far larger than a sketch, of which just 0.8 or less is contained; and a bit map so full that it drops little."""
    monkeypatch.setattr(dec, "LEAST_BITS", 9)
    monkeypatch.setattr(dec, "MOST_BITS", 9)
    monkeypatch.setattr(dec, "MAP_BITS", 512)
    monkeypatch.setattr(dec.F, "bitmap_construct_agg", lambda c: F.substring(bitmap(c), 1, 64))
    rng = random.Random(8)
    items = [(k, prose(rng, 104 + 40 * k)) for k in range(30)]
    cut = lambda t, s: " ".join(t.split()[: int(s * (len(t.split()) - 4)) + 5])
    rows = [(2 * k + j, prose(rng, 400) + " | " + cut(t, s) + " | " + prose(rng, 2000)) for k, t in items for j, s in enumerate((0.8, 0.72))]
    got = {(r.doc_id, r.item_id) for r in dec.matches(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contained(rows, items) and len(got) == 30


bitmap = F.bitmap_construct_agg


# ---------------------------------------------------------------- chunks


@pytest.mark.parametrize("hot", [1000, 2])
def test_chunk_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    rows = corpus()
    got = chunk_dedup.chunk_dedup(table(spark, rows)).collect()
    first = {}
    cut = {k: next(iter(chunk_dedup.chunks(pa.array([t])))) for k, (_, t) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        for d in cut[k][2]:
            if d and i is not None:
                first[d] = min(first.get(d, i), i)
    want = []
    for k, (i, t) in enumerate(rows):
        seen, start, marks = set(), 0, []
        for e, d in zip(*cut[k][1:], strict=True):
            marks += [d in seen or (i is not None and first[d] != i)] * (e - start)
            seen.add(d)
            start = e
        body, kept, gone, spans, at = cut[k][0], b"", 0, 0, 0
        for drop, run in itertools.groupby(marks):
            n = len(list(run))
            if drop and (n >= 96 or n == len(body)):
                gone, spans = gone + n, spans + 1
            else:
                kept += body[at : at + n]
            at += n
        want.append((i, len(body), gone, spans, hashlib.sha256(kept).hexdigest(), len(cut[k][1])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert chunk_dedup.chunk_dedup(table(spark, rows).limit(0)).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(9)
    text = prose(rng, 3000)
    ends = lambda t: {d for _, _, ds in chunk_dedup.chunks(pa.array([t])) for d in ds}
    a, b = ends(text), ends(text[:5000] + "inserted words " + text[5000:])
    assert len(a - b) <= 4
    for body, e, _ in chunk_dedup.chunks(pa.array([text, "", "short", "z" * 5000])):
        sizes = np.diff([0, *e])
        assert e[-1:] == [len(body)][: len(e)] and (sizes <= chunk_dedup.MOST).all() and (sizes[:-1] >= chunk_dedup.LEAST).all()


def test_chunks_of_short_texts_and_ends_take_part(spark):
    text = prose(random.Random(5), 400)
    rows = [(0, "a short text"), (1, "a short text"), (2, text), (3, text), (4, "another one")]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in chunk_dedup.chunk_dedup(table(spark, rows)).collect()}
    assert got == {0: (12, 0), 1: (12, 12), 2: (len(text), 0), 3: (len(text), len(text)), 4: (11, 0)}
    assert all(len(ds) == len(e) and None not in ds for _, e, ds in chunk_dedup.chunks(pa.array([t for _, t in rows])))


def test_chunk_filter_keeps_columns(spark):
    d = table(spark, corpus())
    out = chunk_dedup.filter_docs(d)
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert out.columns == d.columns and out.count() == d.count() and texts[0] == dict(corpus())[0] and texts[63] is None
    assert len(texts[10]) < 40 and len(texts[45]) < len(dict(corpus())[45])


# ---------------------------------------------------------------- long texts


@pytest.fixture(scope="module")
def long_texts():
    """A text of over a megabyte, one in which every 2000th word differs, a short text with 40 words of it, and one of its own."""
    rng = random.Random(31)
    words = prose(rng, 220_000).split()
    changed = ["0" * 7 if k % 2000 == 100 else w for k, w in enumerate(words)]
    own, other = prose(rng, 80), prose(rng, 80)
    return words, changed, own, [(1, " ".join(words)), (2, " ".join(changed)), (3, own + "0 " + " ".join(words[150_000:150_040])), (4, other)]


def test_suffix_dedup_of_long_texts(spark, long_texts):
    words, changed, own, rows = long_texts
    kept = ["".join(words[100::2000]), "0" * 7 * len(words[100::2000]), own + "0", rows[3][1]]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect()}
    assert got == {i: (len(t) - len(k), hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in zip(rows, kept, strict=True)}


def test_near_dedup_of_long_texts(spark, long_texts):
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, long_texts[3])).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_decontamination_of_long_texts(spark, long_texts):
    words, changed, _, rows = long_texts
    items = spark.createDataFrame([(7, " ".join(words[150_000:150_040])), (8, " ".join(changed[90:110])), (9, rows[0][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dec.matches(table(spark, rows), items).collect()} == {(1, 7), (2, 7), (3, 7), (2, 8), (1, 9), (2, 9)}


def test_chunk_dedup_of_long_texts(spark, long_texts):
    got = {r.doc_id: r.n_removed / r.n_bytes for r in chunk_dedup.chunk_dedup(table(spark, long_texts[3])).collect()}
    assert got[1] == got[4] == 0 and 0.9 < got[2] < 1


def test_near_dedup_of_one_id_with_two_texts(spark):
    """Rows that share an id are judged by their own text; the class keeps its smallest id."""
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(2))
    rows = [(0, b), (1, a), (1, b), (2, a + " more"), (3, b), (3, ""), (None, a), (2, a + " more")]
    docs = table(spark, rows)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.filter_docs(docs).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(0, b), (1, a), (3, ""), (None, a)], key=str)
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_dedup(docs).collect()), key=str)
    assert got == sorted([(0, 0, True), (1, 1, True), (1, 0, False), (2, 1, False), (2, 1, False), (3, 0, False), (3, 3, True), (None, None, True)], key=str)
