"""Branches that the derived claim tables don't reach."""

import re

import pytest

from claimloom.operators import content, evidence, extract, search, validate, verdict
from claimloom.sources import ingest
from claimloom.streaming import events


def page(spark, text, kind="insurance_policy", file="p.pdf"):
    return spark.createDataFrame([("C1", 1, 1, file, text, kind)], "claim_id string, page_seq int, page_number int, source_file string, text string, page_type string")


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Insurer: Sunrise Mutual | Plan", "Sunrise Mutual"),
        ("Insurer: verified direct\nStar Health and Allied Insurance Co. Ltd.", "Star Health and Allied Insurance Co. Ltd"),
        ("cover by Tata AIG General Insurance Company Ltd", "Tata AIG General Insurance Company Ltd"),
        ("For Niva Bupa Family plan", "Niva Bupa"),
        ("Key Features Health Insurance", None),
        ("Welcome to Granite Oak General Insurance", "Granite Oak General Insurance"),
        ("nothing here", None),
    ],
)
def test_insurer(spark, text, name):
    assert extract.insurer(page(spark, text)).first()["insurer_name"] == name


def test_insured_persons_of_a_table(spark):
    text = "Policyholder: Aarav Mehta\n| Meera Mehta 01/02/1980 SPOUSE\nNominee Details SELF\nRohan Iyer 34 Male"
    r = extract.holder_and_insured(page(spark, text)).first()
    assert r["insured_names"] == ["Aarav Mehta", "Meera Mehta", "Rohan Iyer"]
    assert r["insured_names_evidence"] == "Policy table insured persons: Meera Mehta, Rohan Iyer"
    assert extract.holder_and_insured(page(spark, text, "medical_bill")).first()["insured_names"] == ["Aarav Mehta"]


def test_fields_have_evidence(spark):
    text = "POLICY SCHEDULE\nPolicy No: AB/1\nSum Insured: Rs. 5,00,000\nTotal Premium: Rs. 900\nBill No: B-7\nInsured Persons: Meera Mehta\nWaiting period of 30 days"
    r = extract.with_fields(page(spark, text)).first()
    proof = {k: v["evidence"] for k, v in r["field_provenance"].items()}
    assert r["relevant_conditions"] == ["Sum Insured: Rs. 5,00,000", "Waiting period of 30 days"]
    assert proof["bill_number"] == proof["invoice_number"] == "Bill No: B-7"
    assert proof["premium_amount"].startswith("Total Premium") and proof["insured_names"] == "Insured Persons: Meera Mehta"


def test_requirements_of_conditions_and_text(spark):
    shape = "claim_id string, page_seq int, document_type string, policy_clauses array<string>, relevant_conditions array<string>, policy_relevant_text string"
    rows = [("C", 1, "insurance_policy", ["1. Final hospital bill"], ["Discharge summary needed"], "CLAIMS PROCEDURE\n2. Police FIR report"), ("C", 2, "insurance_policy", None, None, None)]
    got = [r["reason"] for r in evidence.extract_requirements(spark.createDataFrame(rows, shape)).orderBy("sr_no").collect()]
    assert got == ["Discharge summary needed", "Final hospital bill", "Police FIR report"]


def test_audit_of_verdicts_and_questions(spark):
    def lacking(*steps, pages=2):
        rows = [("C", k, tool, ok, pages, valid) for k, (tool, ok, valid) in enumerate(steps)]
        got = verdict.audit_prerequisites(spark.createDataFrame(rows, "claim_id string, id long, tool_name string, success boolean, page_count long, valid_pages long")).collect()
        return [r["lacking"] for r in got]

    v, d, m, c = ("document_validation", True, 2), ("validity_checker", True, None), ("missing_document_detector", True, None), ("cross_document_consistency_check", True, None)
    end, ask = ("claim_preparation", True, None), ("ask_user", True, None)
    assert lacking(end) == ["document_validation"] and lacking(end, pages=0) == ["document_extraction"] and lacking(ask, pages=0) == []
    assert lacking(v, d, m, end) == ["cross_document_consistency_check"] and lacking(v, d, m, end, pages=1) == [] and lacking(v, d, m, c, end) == []
    failed = ("document_validation", False, 1)
    assert lacking(failed, end) == ["validity_checker"] and lacking(failed, ask) == []
    assert lacking(("document_validation", False, 0), end) == [] and lacking(v, ("validity_checker", False, None), end) == []
    assert lacking(v, ask) == ["validity_checker"] and lacking(v, d, m, ("cross_document_consistency_check", False, None), ask) == []


def test_facts_and_field_view(spark):
    shape = "claim_id string, page_seq int, page_number int, source_file string, document_title string, document_date string, patient_name string"
    pages = spark.createDataFrame([("C", 1, 1, "a.pdf", "Indoor Case Paper", "01/01/2024", "Meera"), ("C", 2, 2, "a.pdf", "Note", None, None), ("D", 1, 1, "b.pdf", "Note", None, "Rohan")], shape)
    checks = spark.createDataFrame([("D", 1, "02/02/2024"), ("D", 2, "03/02/2024"), ("C", 1, "09/09/2024")], "claim_id string, seq int, checked_date string")
    reported = spark.createDataFrame([("D", "Patient Name", "Rohan Iyer")], "claim_id string, name string, value string")
    facts = search.claim_facts(pages, ("patient_name",), checks, None, reported)
    got = {r["claim_id"]: (r["patient_name"], r["admission_date"], r["discharge_date"]) for r in facts.collect()}
    assert got == {"C": ("Meera", "01/01/2024", "09/09/2024"), "D": ("Rohan Iyer", "02/02/2024", "03/02/2024")}
    view = search.field_view(search.page_fields(pages, ("patient_name",)), facts).filter("claim_id = 'C'").collect()
    assert {(r["field_name"], r["field_value"]) for r in view} == {("patient_name", "Meera"), ("page", "Note"), ("admission_date", "01/01/2024"), ("discharge_date", "09/09/2024")}


def test_clauses_of_claims_without_a_policy(spark):
    shape = "claim_id string, page_seq int, page_number int, document_type string, document_title string, policy_clauses array<string>"
    pages = spark.createDataFrame([("C", 1, 1, "insurance_policy", "Policy", ["1. Bill"]), ("C", 2, 2, "other", "Note", None), ("D", 1, 1, "other", "Letter", None)], shape)
    assert {(r["claim_id"], r["clause"]) for r in search.clauses(pages).collect()} == {("C", "1. Bill"), ("C", "Policy"), ("D", "Letter")}


def test_slots_by_path(spark):
    pages = spark.createDataFrame([("C", "x.pdf", "/up/C/X.pdf", None), ("C", "y.pdf", "/up/C/y.pdf", None), ("C", "P.PDF", "/z/p.pdf", "policy"), ("C", "q.pdf", None, None)], "claim_id string, source_file string, file_path string, slot string")
    files = spark.createDataFrame([("C", "policy", "p.pdf", None), ("C", "claim", "p.pdf", None), ("C", "claim", None, "/up/c/x.pdf")], "claim_id string, slot string, name string, path string")
    got = {r["source_file"]: r["assigned_slot"] for r in validate.assign_slots(pages, files).collect()}
    assert got == {"x.pdf": "claim", "y.pdf": None, "P.PDF": "policy", "q.pdf": None}


def test_signals_are_those_of_the_patterns(spark):
    flat = [(name, p, k) for name, patterns in content.FAMILIES.items() for p, k in patterns]
    bodies = [re.sub(r"\(\?:|[()\\\[\]?*+]", " ", p) for _, p, _ in flat]
    texts = [*bodies, *(b.replace("|", "\n").upper() for b in bodies), *(re.sub(r"\|.*", "", b).strip("b s").replace(" s ", " ") for b in bodies), "policy no. AB/1", "sum\t\ninsured", "resumes", ""]
    got = content.with_signals(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    found = 0
    for r in got:
        for name in content.FAMILIES:
            want = [k for n, p, k in flat if n == name and re.search(p, texts[r["k"]].lower(), re.ASCII)]
            assert r[f"{name}_signals"] == want, texts[r["k"]]
            found += len(want)
    assert found > 40


def test_pages_without_text_are_unknown(spark):
    pages = spark.createDataFrame([(None, "policy.pdf"), (" ", "a.pdf"), ("x", "a.pdf")], "text string, source_file string")
    assert [r["page_type"] for r in content.classify_pages(pages).collect()] == ["unknown", "unknown", "other"]


def test_json_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "b"}), (2, None)], "id long, props map<string,string>")
    text = ingest.to_json_cols(df, "props")
    assert [r["props"] for r in text.collect()] == ['{"a":"b"}', None]
    assert ingest.parse_json_cols(text, {"props": "map<string,string>"}).collect() == df.collect()
    for name in ("C1/b.pdf", "C1/policy.PDF", "C1/note.txt", "C2/a.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-")
    got = sorted(tuple(r) for r in ingest.read_bundles(spark, str(tmp_path)).select("claim_id", "source_file", "file_seq").collect())
    assert got == [("C1", "b.pdf", 2), ("C1", "policy.PDF", 1), ("C2", "a.pdf", 1)]


def test_complete_ends_a_run(spark):
    rows = [("C", f"2024-01-01 00:00:0{k}", t) for k, t in enumerate(("plan", "complete", "plan", "decision"))]
    log = spark.createDataFrame(rows, "claim_id string, at string, type string").selectExpr("claim_id", "cast(at as timestamp) AS ts", "type")
    got = sorted((r["n_events"], r["completed"]) for r in events.run_end(log, "10 seconds").collect())
    assert got == [(2, False), (2, True)]


def test_run_end_and_counters_as_streams(spark, tmp_path):
    rows = [("C", "2024-01-01 00:00:00", "plan", 1, "t", 1.0), ("C", "2024-01-01 00:00:01", "complete", 1, "t", 1.0), ("D", "2024-01-03 00:00:00", "plan", 1, "t", 1.0)]
    log = spark.createDataFrame(rows, "claim_id string, at string, type string, iteration long, tool_name string, duration double").selectExpr("claim_id", "cast(at as timestamp) AS ts", "type", "iteration", "tool_name", "duration")
    log.write.parquet(f"{tmp_path}/in")
    for name, make in (("runs", events.run_end), ("counts", lambda e: events.status_counts(e, "1 hour"))):
        events.run_to_end(make(events.tail_events(spark, f"{tmp_path}/in")), f"{tmp_path}/{name}", f"{tmp_path}/state-{name}")
    (run,) = [r for r in spark.read.parquet(f"{tmp_path}/runs").collect() if r["claim_id"] == "C"]
    assert run["n_events"] == 2 and run["completed"]
    assert {(r["type"], r["n_events"]) for r in spark.read.parquet(f"{tmp_path}/counts").collect() if r["window_start"].day == 1} == {("plan", 1), ("complete", 1)}
