import pytest

from claimloom.functions import scalars as s

DATES = [
    ("1/2/2025", "2025-02-01"), (" '19/10/2024' ", "2024-10-19"), ("19/Oct/2024", "2024-10-19"), ("12 March 2025", "2025-03-12"),
    ("Mar 5, 2024", "2024-03-05"), ("March 5 2024", "2024-03-05"), ("20240131", "2024-01-31"), ("2024/1/2", "2024-01-02"), ("5.6.2024", "2024-06-05"),
    ("12-mar-2025", "2025-03-12"), ("31/02/2025", None), ("2024-13-01", None), ("1-2-24", "0024-02-01"), ("x", None), ("", None), (None, None),
]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", make("x").alias("y")).orderBy("i").collect()]


def test_claim_dates(spark):
    assert column(spark, [x for x, _ in DATES], lambda c: s.parse_claim_date(c).cast("string")) == [y for _, y in DATES]


def test_plausible_dates(spark):
    got = column(spark, ["12/03/2025", "2025-03-12", "12-Mar-2025", "31/02/2025", "45/13/2025", "1/2/24", "2025", ""], s.plausible_date)
    assert got == [True, True, True, True, False, False, False, False]


@pytest.mark.parametrize(("strip", "expected"), [(True, [48500.0, 350.5, 12.0, None, -5.0, None, None]), (False, [48500.0, 350.5, None, None, -5.0, None, None])])
def test_amounts(spark, strip, expected):
    got = column(spark, ["48,500.00", "₹ 350.50", "Rs.12", "12d", "-5", "nan", None], lambda c: s.parse_amount(c, strip))
    assert [None if x is None else float(x) for x in got] == expected


def test_names(spark):
    assert column(spark, ["Sunrise Shield General Insurance Co. Ltd", "The Insurance Company"], s.company_tokens) == [["sunrise", "shield"], ["the", "insurance", "company"]]
    assert column(spark, ["Mr. Aarav  Mehta", "Mehta, Aarav"], s.person_tokens) == [["aarav", "mehta"], ["mehta", "aarav"]]
    assert column(spark, ["000ABH-2018/12.3", "abh 2018_123"], s.policy_key) == ["abh2018123", "abh2018123"]


def test_requirements(spark):
    assert column(spark, ["1. Original bill with receipt", "* Claim form duly signed"], s.requirement_title) == ["Original bill", "Claim form"]


def test_loose_values(spark):
    assert column(spark, ["yes", "0", "maybe", None], s.loose_bool) == [True, False, None, None]
    assert column(spark, ["3", "0", "-1", "x", None], s.loose_page_number) == [3, None, None, None, None]
    assert column(spark, ['say ```json\n{"a": 1}\n``` ok', 'x {"a": {"b": 2}} y', "[1]", "none"], s.first_json_object) == ['{"a": 1}', '{"a": {"b": 2}}', '{"document_results":[1]}', None]


def test_dates_of_every_form_and_none(spark):
    import datetime as dt

    forms = {
        "5/3/2024": (2024, 3, 5), "05-03-2024": (2024, 3, 5), "5.3.2024": (2024, 3, 5), "2024-3-5": (2024, 3, 5), "1850/03/05": (1850, 3, 5), "20240305": (2024, 3, 5),
        "5 Mar 2024": (2024, 3, 5), "5-march-2024": (2024, 3, 5), "MAR 5, 2024": (2024, 3, 5), "'5/3/2024'": (2024, 3, 5), " 2024, 3, 5 ": (2024, 3, 5), "5/3/99": (99, 3, 5),
        "29/02/2024": (2024, 2, 29), "29/02/2023": None, "31-04-2024": None, "2024-13-01": None, "20240230": None, "5/3/0000": None, "00000305": None, "": None, "''": None, "5 March": None, "soon": None,
    }
    df = spark.createDataFrame([(k,) for k in [*forms, None]], "x string")
    got = {r["x"]: r["d"] for r in df.select("x", s.parse_claim_date("x").alias("d")).collect()}
    assert got == {k: v and dt.date(*v) for k, v in forms.items()} | {None: None}
