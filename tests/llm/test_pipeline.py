"""The corpus pipeline against a brute-force version on a small corpus with every kind of planted case."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymill.llm import toxicity
from tests.llm.test_dedup import DOCS, brute_classes
from tests.llm.test_texts import judged

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    toxic, labels = judged(spark, 240)
    rows = [tuple(r)[:5] for r in toxic.collect()]
    words = sorted({w for r in rows if r[0] % 4 for w in r[1].split()})  # what the classifier knows as harmless
    prose = lambda rng, n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(rng, 120)
    item = prose(rng, 30)
    more = [base, base, base, " ".join([*base.split()[:5], "rivers", *base.split()[6:]]), prose(rng, 80) + " " + item + " " + prose(rng, 9), "", None, "", prose(rng, 3000)]
    rows += [(1000 + k, t, "en", "s", 1) for k, t in enumerate(more)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_what_brute_force_keeps(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{tables}/documents.parquet"), model).collect() if r.predicted}
            want = {k: t for k, t in want.items() if k not in bad}
            assert 40 <= len(bad) <= 80
        elif name == "exact_dedup":
            keep = {t or "": k for k, t in sorted(want.items())}
            want = {k: want[k] for k in keep.values()}
        elif name == "near_dedup":
            classes = brute_classes(sorted(want.items()))
            want = {k: t for k, t in want.items() if classes[k] == k}
        else:
            want.pop(1004)
        assert docs.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "kept"]
        assert {r.doc_id: r.text for r in docs.collect()} == want
    assert [k for k in want if k >= 1000] == [1002, 1007, 1008]


def test_run_packs_what_is_kept(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.asarray([*tok.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()}
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def write_tables(spark, path, rows):
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    docs = write_tables(spark, str(tmp_path), [])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_and_ties(spark, tmp_path):
    """No labels, no items; rows without an id, repeated rows and ids, and a near copy of a text that exact dedup has reduced."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    text, near, other = " ".join(words), " ".join([*words[:100], "changed", *words[101:]]), " ".join(reversed(words))
    rows = [(None, other), (None, other), (1, text), (1, text), (2, text), (3, near), (3, near), (4, ""), (None, None), (5, "...")]
    write_tables(spark, str(tmp_path), [(i, t, None, None, None) for i, t in rows])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.length) for r in got if r.doc_id in (4, 5)) == [("4", 1), ("5", 2)]
    assert {r.doc_id for r in got} == {None, 2, 4, 5}
    assert sum(r.length for r in got if r.doc_id is None) == 2 * next(r.doc_tokens for r in got if r.doc_id is None)
