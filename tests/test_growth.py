"""What the record queries must not do, as it makes them grow: work twice, or work on rows and columns that nothing needs."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tallymill.functions import amounts as A
from tallymill.functions import unicode as U
from tallymill.operators import errors, extract
from tallymill.plans import queries

SF = "/root/testdata/sf0.001"


def nodes(df) -> list[str]:
    """The lines of the optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_scalar_errors_print_only_wrong_records(spark):
    conditions = [x for x in nodes(queries.error_scalars(spark, SF)) if re.match(r"[\s:+-]*Filter", x)]
    assert conditions and not [x for x in conditions if "format_number" in x]


def test_bucket_report_finds_errors_once(spark):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(b):
        ran.add(1)
        return b

    found = spark.range(40).select(F.when(F.col("id") % 4 == 0, "ocr").otherwise("missed").alias("bucket"), F.format_string("e%02d", "id").alias("example"))
    rows = errors.bucket_report(found.withColumn("bucket", seen("bucket")), F.col("example"), 2).orderBy("place").collect()
    assert [(r["bucket"], r["count"], r["examples"]) for r in rows[:2]] == [("ocr", 10, ["e00", "e04"]), ("missed", 30, ["e01", "e02"])]
    assert ran.value == 40


def test_decisions_make_no_details(spark):
    assert not [x for x in nodes(queries.validate_rules(spark, SF)) if "format_number" in x]


def test_amounts_of_tokens_need_no_patterns(column):
    r = random.Random(3)
    texts = ["".join(r.choice("0123456789012.,, -()") for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["1,\t234.5", "12 345", "-(1.234,56)", "00", "1\x0b234"]
    tokens = [t for text in texts for t in re.findall(A.AMOUNT, text, re.ASCII)]
    assert len(tokens) > 3000
    assert column(A.amount_of, tokens) == column(lambda c: F.abs(A.parse_narrow(c)), tokens)


def test_every_label_has_what_is_looked_for_first(spark):
    kinds = [(p, h) for p, h in vars(extract).items() if f"{p}_HAS" in vars(extract)]
    assert len(kinds) == 7
    lines = ["SUB-TOTAL 1", "sub ttl 2", "Net Amt", "TOTAL ITEM PRICE", "Grand  Total", "otal 5", "JUMLAH", "Amount Due", "PB 1", "PPN", "vat", "PAJAK", "Tax", "S.C 5", "sc. 2", "SC", "s.c. 1", "SVC", "serv charge", "SERVICE", "Discount", "POTONGAN", "cash", "TUNAI", "Change", "kembali", "3 x tea 5"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for p, pattern in kinds:
        fast = extract.matches(F.col("line"), F.lower("line"), pattern, vars(extract)[f"{p}_HAS"])
        assert df.filter(fast != F.col("line").rlike(pattern)).count() == 0
        assert df.filter(fast).count() > 0


def test_item_errors_match_records_once(spark):
    for name in ("error_items", "error_items_unread"):
        plan = "\n".join(nodes(queries.QUERIES[name](spark, SF)))
        assert len(re.findall(r"ArrowEvalPython \[matched", plan)) == 1 and len(re.findall("Relation", plan)) == 2


def test_rules_are_counted_without_details(spark):
    plan = nodes(queries.rule_long_form(spark, SF))
    assert not [x for x in plan if "format_number" in x] and max(map(len, plan)) < 20_000


def test_thresholds_share_one_validation(spark):
    assert sum("AS rule_schema" in x for x in nodes(queries.threshold_inert(spark, SF))) <= 1


def test_whole_texts_are_not_cut_into_characters(spark):
    plan = "\n".join(nodes(queries.normal_texts(spark, SF)))
    assert "lambda" not in plan and "regexp_extract_all" not in plan


def test_normal_form_of_ascii_stays_out_of_python(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'plain'), (2, 'e\u0301\uff21'), (3, CAST(x'61FF' AS STRING)), (4, ''), (5, NULL) t(i, s)").coalesce(1)
    assert [r.n for r in df.orderBy("i").select(U.nfkc(F.col("s")).alias("n")).collect()] == ["plain", "éA", "a\ufffd", "", None]


def test_printed_lines_are_read_once_and_not_by_expressions(spark):
    plan = "\n".join(nodes(queries.extract_printed(spark, SF)))
    assert len(re.findall(r"ArrowEvalPython \[line_parts", plan)) == 1 and "regexp_extract" not in plan and "Contains" not in plan and "contains" not in plan.lower()


def test_labels_of_lines_are_those_of_the_patterns(spark):
    r = random.Random(5)
    pool = ["sub", "Total", "otal", "TAX", "pb", "1", "svc", "s.c.", "disc", "cash", "net", "amt", "item", ":", " ", "  ", "-", "_", "é", "\u0301", "½", "７", "ſ", "\u212a", "qty", "Grand", "t", "l", "\n", "\u00a0"]
    lines = ["".join(r.choice(pool) for _ in range(r.randint(1, 7))) for _ in range(5000)]
    patterns = {"sub": extract.SUBTOTAL, "grand": extract.GRAND, "tax": extract.TAX, "svc": extract.SERVICE, "disc": extract.DISCOUNT, "stop": extract.STOP}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("p", extract.line_parts(F.array("line"))[0])
    df = df.withColumn("whole", F.col("line").rlike(extract.TOTAL) & ~F.col("line").rlike(extract.NOT_TOTAL))
    wrong = df.filter((F.col("p")["total"] != F.col("whole")) | F.greatest(*[F.col("p")[k] != F.col("line").rlike(x) for k, x in patterns.items()]))
    assert wrong.select("line").take(3) == []


def test_amounts_in_batches_are_those_of_expressions(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("0123456789012.,, -()x½２\t") for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["1" * 400, None]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", A.amounts_in(F.col("line")).alias("a"), A.amounts_of_lines(F.array("line"))[0].alias("b"))
    assert df.filter(F.coalesce("a", F.array().cast("array<double>")) != F.col("b")).take(3) == []
    assert [x.b for x in spark.sql("SELECT CAST(NULL AS ARRAY<STRING>) AS s UNION ALL SELECT array()").select(A.amounts_of_lines("s").alias("b")).collect()] == [None, []]


def test_items_of_lines_are_those_read_one_by_one():
    r = random.Random(6)
    pool = ["12", "3", " ", "x", "X", "tea", "Ring", "(", "-", "1,234", ".50", "@", ":", "é", "\n", "\t", "a"]
    lines = ["".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(5000)]
    name, quantity = (x.to_pylist() for x in extract.items_of(pa.array(lines)))
    word = lambda x: re.search(extract.WORD, x) is not None
    want = [extract.item_of(x) if word(x) and word(extract.item_of(x)[0]) else (None, None) for x in lines]
    assert list(zip(name, quantity)) == want


def test_number_strings_are_found_in_batches(spark):
    for name in ("error_scalars", "error_normalisation"):
        plan = "\n".join(nodes(queries.QUERIES[name](spark, SF)))
        assert len(re.findall(r"ArrowEvalPython \[number_strings", plan)) == 1 and "regexp_extract_all" not in plan


def test_number_strings_of_odd_lines(column):
    lists = [["1 2,00 x 3", "4"], ["5\t6.7", "8"], ["10.00", "10"], [], None, ["1", None], ["1\x1e2", "٣"]]
    want = [["1200", "12", "1", "200", "3", "4"], ["567", "5", "67", "8"], ["1000", "10"], [], None, None, ["1", "2"]]
    assert column(A.number_strings, lists, "array<string>") == want
