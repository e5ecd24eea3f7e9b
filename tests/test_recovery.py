"""JSON recovered from answers, requirements from all sources, page types by banner."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalars
from claimloom.operators import content, evidence

ITEM = {"sr_no": 1, "document_title": 'A "quoted" {title', "missing": False, "page_number": 2}

ANSWERS = [
    ("fenced array", f"Sure:\n```json\n[{json.dumps(ITEM)}]\n```", {"document_results": [ITEM]}),
    ("bare array", f"  [{json.dumps(ITEM)}, {json.dumps(ITEM)}]\n", {"document_results": [ITEM, ITEM]}),
    ("array in prose", f"So: [{json.dumps(ITEM)}, {json.dumps(ITEM)}] that's it", {"document_results": [ITEM, ITEM]}),
    ("object", json.dumps({"document_results": [ITEM]}), {"document_results": [ITEM]}),
    ("prose around", "It's {not} this: " + json.dumps({"a": [ITEM]}) + " is it?", {"document_results": [ITEM]}),
    ("trailing braces", json.dumps({"a": ITEM}) + " }}}", {"a": ITEM}),
    ("broken fence, then good", '```json\n{"a": [\n```\nand\n```\n{"b": 1}\n```', {"b": 1}),
    ("two objects", '{"a": 1} or {"b": 2}', {"a": 1}),
    ("never closed before", '{"x": [1, 2  and then {"b": "}"}', {"b": "}"}),
    ("escapes", r'x {"a": "say \"}\" and \\"} y } z', {"a": 'say "}" and \\'}),
    ("pairs", """{'action': ' verify ', "reason": "be"cause", "action_input": {"page": 2}""", {"action": "verify", "reason": "be", "action_input": {"page": 2}}),
    ("pair without reason", """ "Action" : "stop it" """, {"action": "stop it", "reason": "Autonomous decision.", "action_input": {}}),
    ("nothing", "no [results] {today}", None),
    ("number", "42", None),
    ("empty", "", None),
    ("null", None, None),
]


def test_first_json_object(spark):
    rows = spark.createDataFrame([(n, t) for n, t, _ in ANSWERS], "name string, x string")
    got = {r["name"]: r["j"] and json.loads(r["j"]) for r in rows.select("name", scalars.first_json_object("x").alias("j")).collect()}
    assert got == {n: want for n, _, want in ANSWERS}


def test_json_spans(spark):
    texts = ['a {"b": [1, {}]} c [2] }', "{[}]", '{"x": "]}{["} ', "{ never", 'it\'s "odd" {"a": 1}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(scalars.json_spans("x")).collect()]
    assert got == [['{"b": [1, {}]}', "[2]"], ["{[}]"], ['{"x": "]}{["}'], [], ['{"a": 1}']]


def test_split_responses(spark, tmp_path):
    responses = spark.createDataFrame([("A", json.dumps([ITEM, ITEM | {"page_number": 9}])), ("B", "nothing"), ("C", json.dumps({"missing_documents": [ITEM | {"missing": True, "page_number": None}, {"missing": "maybe", "document_title": "t"}]}))], "claim_id string, response_json string")
    pages = spark.createDataFrame([("A", 2)], "claim_id string, page_number int")
    good, bad, counts = evidence.split_responses(evidence.validate_responses(responses, pages), f"file://{tmp_path}/out")
    assert counts == {"items": 5, "good": 2, "quarantined": 3}
    assert sorted((r["claim_id"], r["sr_no"]) for r in good.collect()) == [("A", 1), ("C", 1)]
    assert sorted((r["claim_id"], r["sr_no"], r["problem"]) for r in bad.collect()) == [("A", 2, "page not submitted"), ("B", 0, "no result list"), ("C", 2, "missing is no boolean")]


SHAPE = "claim_id string, page_seq int, document_type string, policy_clauses array<string>, relevant_conditions array<string>, policy_relevant_text string"
POLICY = "insurance_policy"


@pytest.mark.parametrize(
    "pages, want",
    [
        ([("A", 1, POLICY, ["1. Clause two must be sent with stamp"], None, None)], [("Clause two must be sent", "1. Clause two must be sent with stamp")]),
        (
            [("A", 1, POLICY, ["- final bill with stamp; claim form"], ["Discharge summary issued by the ward"], "2. FIR copy\nfinal BILL again stating"), ("A", 2, POLICY, ["invoice"], ["claim FORM"], " ")],
            [("Discharge summary", "Discharge summary issued by the ward"), ("final bill", "final bill with stamp"), ("claim form", "claim form"), ("FIR copy", "FIR copy"), ("final BILL again stating", "final BILL again stating"), ("invoice", "invoice")],
        ),
        # one line with a document word keeps the bare clauses out
        ([("A", 1, POLICY, ["Room rent is capped"], None, "Police report")], [("Police report", "Police report")]),
        ([("A", 1, POLICY, ["3) Room rent", "", "room RENT with cap", "x" * 80], None, None)], [("Room rent", "3) Room rent"), ("x" * 60, "x" * 80)]),
        ([("A", 1, "medical_bill", ["bill"], None, None)], []),
        ([("A", 1, POLICY, None, None, None)], []),
    ],
)
def test_requirements(spark, pages, want):
    got = evidence.extract_requirements(spark.createDataFrame(pages, SHAPE)).orderBy("sr_no").collect()
    assert [(r["document_title"], r["reason"]) for r in got] == want
    assert [r["sr_no"] for r in got] == list(range(1, len(want) + 1))


def test_page_types_by_banner(spark):
    pages = [
        ("SECTION B: COVERAGE", "insurance_policy"), ("\n  Section 4 (Part II) - General", "insurance_policy"), ("DOCUMENT 2: FINAL BILL", "hospital_document"), ("document 3 - Ultrasound of the knee", "medical_report"),
        ("x\nDOCUMENT 9: Pharmacy Tax Invoice", "medical_bill"), ("DOCUMENT 1: OTHER\nFirst Information Report", "hospital_document"), ("DOCUMENT 1: OTHER\nPolicy Schedule", "insurance_policy"), ("CLAIM FORM - PART A", "other"),
        ("a DOCUMENT 2: BILL", "other"), ("SECTION B:", "other"), ("", "unknown"), (None, "unknown"),
    ]
    got = content.classify_pages(spark.createDataFrame([(k, t, "f.pdf") for k, (t, _) in enumerate(pages)], "k int, text string, source_file string")).orderBy("k").select("page_type")
    assert [r[0] for r in got.collect()] == [w for _, w in pages]
    assert got.filter(F.col("page_type").isNull()).count() == 0


def test_bucketed_leaves_no_table_behind(spark):
    from claimloom.sources.scratch import bucketed

    before = spark.sql("SHOW TABLES").count()
    rows = bucketed(spark.range(100).selectExpr("id % 7 AS claim_id", "id"), "claim_id", "gone")
    assert spark.sql("SHOW TABLES").count() == before
    out = rows.groupBy("claim_id").agg(F.count("*").alias("n"))
    assert sum(r["n"] for r in out.collect()) == 100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Scan")[0]


def test_signals_of_odd_texts(spark):
    texts = ["POLICY SCHEDULE\nSum  Insured: 5", "policyschedule", "a policy\u00e9schedule", "xpolicy schedule", "", None, "no police station here; FIR no 3", "policy schedule " * 5000]
    got = content.with_signals(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).orderBy("k").collect()
    heads = [r["policy_signals"][:1] for r in got]
    assert heads == [["contract_schedule_heading"], ["contract_schedule_heading"], [], [], [], [], [], ["contract_schedule_heading"]]
    assert got[0]["policy_signals"] == ["contract_schedule_heading", "sum_insured_provision"] and got[6]["incident_signals"] == ["police_incident_record"]
    assert "text" in got[0].asDict() and "_masks" not in got[0].asDict()
