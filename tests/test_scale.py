"""Searches that are narrowed first find what the plain ones find."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from claimloom.functions.scalars import _PLAUSIBLE, _plausible_parts, found, lowered, opened_at, parse_claim_date, plausible_date, with_claim_dates
from claimloom.operators import consistency, content, evidence, extract, search
from claimloom.plans import core, more
from claimloom.sources import fixtures


def test_texts_opened_at_a_label_give_what_whole_texts_give(spark):
    cases = {
        extract.PATIENT: ("patient", "ptient", "complainant", "pt.", "claimant"), extract.DOCTOR: ("treating", "consultant", "prescribing", "operating", "surgeon"),
        extract.RECEIPT: ("receipt",), extract.BILL: ("bill", "invoice"), extract.TOTAL: ("total", "invoice", "net", "grand"), extract.NUMBER_LABEL: ("policy",),
        extract.OWN_DATE[0]: ("date", "incident", "bill", "admission", "report", "record"),
    }
    words = [w for ws in cases.values() for w in ws] + ["İ", "é\u0301", "Name: A Rao", "No. 12/A", "Date: 1/2/2024", "Amount: Rs. 5,000.50", "Number: P-1", "\n", "x", "Doctor: B Sen", "|"]
    draw = random.Random(7)
    texts = [(k, "".join(draw.choice((w, w.upper(), w.title())) + draw.choice((" ", "", "\n", "_")) for w in draw.choices(words, k=12))) for k in range(400)]
    texts += [(400, None), (401, ""), (402, "İİİİİİİİİİİİİİİİİİİİ Patient: A Rao\n"), (403, "inpatient: B Rao\nPATIENT NAME: C Rao")]
    df = spark.createDataFrame(texts, "k int, text string").withColumn("low", lowered(F.col("text")))
    x, differs = F.col("text"), F.lit(False)
    for p, starts in cases.items():
        differs = differs | ~found(x, p).eqNullSafe(found(opened_at(x, F.col("low"), starts), p))
    assert df.filter(differs).collect() == []
    assert df.filter("k >= 402").select(found(opened_at(x, F.col("low"), ("patient",)), extract.PATIENT)).collect() == [("A Rao",), ("C Rao",)]


def test_each_brand_holds_its_mark():
    assert all(any(m in re.sub(r"\\s\+", " ", b).lower() for m in marks) for b, marks in zip(extract.BRANDS, extract.BRAND_MARKS, strict=True))


def _reads(df) -> int:
    return len(re.findall(r"Scan ExistingRDD|LocalTableScan", df._jdf.queryExecution().executedPlan().toString()))


def test_evidence_reads_requirements_and_responses_once(spark):
    need = spark.sparkContext.parallelize([("C1", 1, "Final hospital bill"), ("C1", 2, "Police FIR"), (None, 1, "Police FIR")]).toDF("claim_id string, sr_no int, document_title string")
    held = spark.sparkContext.parallelize([("C1", 2, 1, "Hospital Bill"), ("C2", 1, 1, "Police FIR"), (None, 1, 1, "Police FIR")]).toDF("claim_id string, page_seq int, page_number int, document_title string")
    got = evidence.match_evidence(need, held)
    assert _reads(got) == 2
    assert {tuple(r) for r in got.collect()} == {("C1", 1, "Final hospital bill", False, 1, "Hospital Bill"), ("C1", 2, "Police FIR", True, None, None), (None, 1, "Police FIR", True, None, None)}
    answers = [("C1", '{"document_results": []}'), ("C2", "none"), ("C3", None), ("C4", '[{"document_title": "a", "missing": "true"}]')]
    answers = spark.sparkContext.parallelize(answers).toDF("claim_id string, response_json string")
    got = evidence.validate_responses(answers, held)
    assert _reads(got) == 2
    assert {(r["claim_id"], r["sr_no"], r["document_title"], r["problem"]) for r in got.collect()} == {("C2", 0, None, "no result list"), ("C3", 0, None, "no result list"), ("C4", 1, "a", None)}


def test_pages_by_claim_are_those_of_the_sql_and_meet_once(spark, tmp_path):
    day = "timestamp'2020-01-05 00:00:00'"
    spark.sql(f"SELECT ok AS o_orderkey, ok * 37 AS o_custkey, 'O' AS o_orderstatus, 10.5D AS o_totalprice, {day} AS o_orderdate FROM VALUES (7L), (97L), (3L), (41L), (6000000000L) AS t(ok)").write.parquet(f"{tmp_path}/orders.parquet")
    line = "cast(id % 9 as int) AS l_linenumber, id * 13 AS l_partkey, id * 11 AS l_suppkey, 1D AS l_quantity, id * 250.25D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus"
    keys = "element_at(array(7L, 97L, 3L, NULL, 55L, 6000000000L), cast(id % 6 as int) + 1) AS l_orderkey"  # lines without an order, orders without lines
    spark.sql(f"SELECT {keys}, {line}, {day} AS l_shipdate FROM range(300)").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = spark.sql(fixtures.PAGES, **{t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("orders", "lineitem")})
    got = fixtures.raw(spark, str(tmp_path), "pages")
    assert got.columns == plain.columns and got.count() == 5 + 200
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    counted = got.groupBy("claim_id").agg(F.max("page_seq"), F.max("bill_amount"))
    # by hash of a claim: lines once, orders beside the pages and for the join; pages and claims never
    assert len(re.findall(r"Exchange hashpartitioning\((?!of_id|id)", counted._jdf.queryExecution().executedPlan().toString())) == 0


def test_field_view_deals_fields_by_claim_alone(spark):
    fields = spark.createDataFrame([("A", "bill", "1"), ("A", "date", "2"), (None, "bill", "3")], "claim_id string, field_name string, field_value string").repartition(4, "claim_id")
    facts = spark.createDataFrame([("A", "x", "y"), ("B", "x", None), ("C", "z", "w"), (None, "x", None)], "claim_id string, bill string, day string")
    got = search.field_view(fields, facts)
    assert "field_name" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", got._jdf.queryExecution().executedPlan().toString()))
    new = {("A", "day", "y"), ("B", "bill", "x"), ("C", "bill", "z"), ("C", "day", "w"), (None, "bill", "x")}
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in fields.collect()} | new


def test_question_context_works_on_claims_asked_about(spark):
    plan = more.o54(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_names_of_facilities_are_cut_into_words_once(spark):
    rows = [("C1", 1, 1, "medical_bill", "Lakeside City Hospital", "P-1"), ("C1", 2, 2, "medical_bill", "Discharge Summary", " - "), ("C1", 3, 3, "medical_bill", None, None)]
    pages = spark.createDataFrame(rows, "claim_id string, page_seq int, page_number int, document_type string, hospital_name string, policy_number string")
    got = consistency.facility_names(pages)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and plan.count("lower(") == 2  # words, and the number of words
    assert [tuple(r) for r in got.collect()] == [("C1", "Lakeside City Hospital", 1, ["lakeside"])]
    assert consistency.policy_number_mismatch(pages)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 3  # one side is read twice


def test_plausible_shapes_are_plausible_by_their_parts(spark):
    draw = random.Random(5)
    parts = ["1", "01", "31", "32", "0", "1899", "1900", "2024", "2100", "2101", "20240", "Jan", "JANUARY", "dec", "Decx", "xJan", "5,", "5.", "é"]
    texts = ["".join(p + draw.choice(("-", "/", " ", ".", ", ", " - ", "")) for p in draw.choices(parts, k=draw.randint(1, 4))).rstrip("-/., ") for _ in range(5000)] + ["", "  ", "31/02/2025", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"got": plausible_date("t"), "want": _plausible_parts(F.col("t"))})
    assert df.filter("NOT (got <=> want)").collect() == []
    assert df.filter(F.trim("t").rlike(_PLAUSIBLE)).count() > 20 and df.filter("NOT got").count() > 100


def test_verdict_writes_what_its_checks_read(spark):
    plan = core.o70(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "doctor_name" not in plan and "diagnosis" not in plan and "hospital_name" in plan


def test_patterns_looked_for_together_are_those_found_alone(monkeypatch):
    families = [[p for p, _ in of] for of in content.FAMILIES.values()]
    draw = random.Random(3)
    words = ["policy", "schedule", "no", "number", "12/A", "\n", " ", ":", "room", "rent", "total", "premium", "lab", "specimen", "resume", "fir", "x", "é", "discharge", "summary", "hospital", "ipd", "co-payment", "deductible"]
    texts = pa.array([None, "", *("".join(w + draw.choice(("", " ", "\n", ".")) for w in draw.choices(words, k=8)) for _ in range(600)), *["nothing here"] * 1000], pa.string())
    looked, plain = [], pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda x, p: looked.append(len(x)) or plain(x, p))
    got = content.pattern_bits(families)(texts)
    assert sum(looked) < 0.6 * len(texts) * sum(map(len, families))
    for of, bits in zip(families, got, strict=True):
        for k, p in enumerate(of):
            assert [bool(b >> k & 1) for b in bits.tolist()] == [bool(x) for x in plain(texts, p).to_pylist()]
    assert [x.tolist() for x in content.pattern_bits(families)(texts[:0])] == [[]] * len(families) and content.pattern_bits([])(texts) == []


def test_dates_in_columns_are_those_parsed_alone(spark):
    draw = random.Random(9)
    parts = ["1", "01", "29", "31", "32", "0", "02", "4", "12", "13", "1900", "1901", "2024", "2023", "0000", "20240", "Feb", "JANUARY", "dec", "Decx", "5,", "é", "'"]
    texts = ["".join(p + draw.choice(("-", "/", " ", ".", ", ", " - ", "", "\n")) for p in draw.choices(parts, k=draw.randint(1, 4))) for _ in range(4000)]
    texts += ["20240229", "20230229", "2023-02-29", "29/02/2024", "31/02/2025", "-1/2/2024", "'1/2/2024'", "1--2/2024", "1/2/2024 10:00", "1/2", "", " ", None]
    df = with_claim_dates(spark.createDataFrame([(t,) for t in texts], "t string"), {"a": "t", "b": F.upper("t")})
    assert df.columns == ["t", "a", "b"]
    assert df.filter(~F.col("a").eqNullSafe(parse_claim_date("t")) | ~F.col("b").eqNullSafe(F.col("a"))).collect() == []
    assert df.filter("a IS NOT NULL").count() > 100


def test_file_names_are_read_for_pages_without_a_number(spark):
    plan = more.o39(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(extract.NUMBER_IN_FILE[0]) < 20  # 39 where each part is looked for in each field that holds it


def test_labels_far_ahead_of_their_date_are_evidence(spark):
    texts = ["x Bill" + " " * 12 + "Date: 1/2/2024", "x Admission Date: 1/2/2024", "Bill Date none\nRecord Date 1-Jan-2024", "Policy" + "\n" * 20 + "Start Date: 1/2/2024 Policy End Date 3/4/2025"]
    got = extract.dates(spark.createDataFrame([(k, t, "invoice") for k, t in enumerate(texts)], "k int, text string, page_type string")).orderBy("k").collect()
    assert [r["document_date_evidence"] for r in got[:3]] == [texts[0][2:], texts[1][2:], "Record Date 1-Jan-2024"]
    assert [r["document_date"] for r in got[:3]] == ["01/02/2024", "01/02/2024", "01/01/2024"]
    assert got[3]["policy_start_date_evidence"] == texts[3][: len("Policy") + 20 + len("Start Date: 1/2/2024")] and got[3]["policy_end_date_evidence"] == "Policy End Date 3/4/2025"
