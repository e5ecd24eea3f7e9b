"""Queries of the claim audit over derived claim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import consistency, evidence, telemetry, validate, validity, verdict
from claimloom.plans import oracles as o
from claimloom.sources.fixtures import load
from claimloom.sources.scratch import bucketed

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def joined(*columns: str):
    return [F.concat_ws("|", c).alias(c) for c in columns]


@query("o14_fill_context", o.query([o.PAGES, o.FILLED], "SELECT claim_id, page_seq, bill_number, hospital_name, patient_name, document_date, policy_number, bill_amount FROM filled"))
def o14(s: SparkSession, d: str) -> DataFrame:
    return validate.fill_context(load(s, d, "pages")).select("claim_id", "page_seq", "bill_number", "hospital_name", "patient_name", "document_date", "policy_number", "bill_amount")


def validated(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_pages(validate.fill_context(load(s, d, "pages")))


@query("o15_required_fields", o.query([o.PAGES, o.FILLED, o.VALIDATED], "SELECT claim_id, page_seq, array_to_string(required_missing, '|') AS required_missing FROM validated"))
def o15(s: SparkSession, d: str) -> DataFrame:
    return validate.check_required(validate.fill_context(load(s, d, "pages"))).select("claim_id", "page_seq", *joined("required_missing"))


@query("o18_validate_pages", o.query([o.PAGES, o.FILLED, o.VALIDATED], "SELECT claim_id, page_seq, array_to_string(missing_fields, '|') AS missing_fields, len(missing_fields) = 0 AS valid FROM validated"))
def o18(s: SparkSession, d: str) -> DataFrame:
    return validated(s, d).select("claim_id", "page_seq", *joined("missing_fields"), "valid")


@query("o55_validation_rollup", o.query([o.PAGES, o.FILLED, o.VALIDATED, o.ROLLUP], "SELECT * FROM rollup"))
def o55(s: SparkSession, d: str) -> DataFrame:
    return validate.validation_rollup(validated(s, d))


@query("o56_slot_alignment", o.query([o.PAGES], f"SELECT claim_id, p AS policy_slot_wrong, c AS claim_slot_wrong, p AND c AS inverted FROM (SELECT claim_id, coalesce(bool_and({o._MEDICAL}) FILTER (WHERE slot = 'policy'), false) AS p, coalesce(bool_and({o.POLICY}) FILTER (WHERE slot = 'claim'), false) AS c FROM pages GROUP BY claim_id)"))
def o56(s: SparkSession, d: str) -> DataFrame:
    return validate.slot_alignment(load(s, d, "pages"))


@query("o57_policy_periods", o.query([o.PAGES, o.PERIODS], "SELECT claim_id, start_text, end_text, strftime(start_day, '%Y-%m-%d') AS start_day, strftime(end_day, '%Y-%m-%d') AS end_day, period_usable FROM periods"))
def o57(s: SparkSession, d: str) -> DataFrame:
    return validity.policy_periods(load(s, d, "pages")).select("claim_id", "start_text", "end_text", F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"), "period_usable")


@query("o41_date_checks", o.query([o.PAGES, o.PERIODS, o.CHECKS], "SELECT * FROM checks"))
def o41(s: SparkSession, d: str) -> DataFrame:
    pages = load(s, d, "pages")
    return validity.date_checks(pages, validity.policy_periods(pages))


@query("o42_identity_lenient", o.query([o.PAGES, o.PATIENTS, o.IDENTITY], "SELECT * FROM identity"))
def o42(s: SparkSession, d: str) -> DataFrame:
    pages = load(s, d, "pages")
    return validity.identity_lenient(pages, validity.policy_periods(pages))


def validity_of(pages: DataFrame, claims: DataFrame) -> DataFrame:
    periods = validity.policy_periods(pages)
    return validity.validity_rollup(validity.date_checks(pages, periods), periods, validity.identity_lenient(pages, periods), claims)


@query("o58_validity_rollup", o.query([o.PAGES, o.PERIODS, o.CHECKS, o.PATIENTS, o.IDENTITY, o.CLAIMS, o.VALIDITY], "SELECT * FROM validity"))
def o58(s: SparkSession, d: str) -> DataFrame:
    return validity_of(load(s, d, "pages"), load(s, d, "claims"))


@query("o43_insurer_pairs", o.query([o.PAGES, o.INSURERS], f"SELECT claim_id, policy_insurer, claim_insurer, match, CASE WHEN match IN ('same_name', 'same_words') THEN 1.0 WHEN match = 'administrator' THEN 0.95 ELSE round({o.sim('pn', 'cn')}, 3) END AS similarity FROM insurer_match"))
def o43(s: SparkSession, d: str) -> DataFrame:
    return consistency.insurer_pairs(load(s, d, "pages"))


@query("o44_policy_number_mismatch", o.query([o.PAGES, o.NUMBERS], "SELECT * FROM number_mismatch"))
def o44(s: SparkSession, d: str) -> DataFrame:
    return consistency.policy_number_mismatch(load(s, d, "pages"))


@query("o45_patient_mismatch", o.query([o.PAGES, o.PATIENTS], "SELECT * FROM patient_mismatch"))
def o45(s: SparkSession, d: str) -> DataFrame:
    return consistency.patient_mismatch(load(s, d, "pages"))


@query("o59_value_pages", o.query([o.PAGES], f"SELECT claim_id, trim(hospital_name) AS value, string_agg(page_number, ',' ORDER BY page_number) AS pages, min(page_seq) AS first_seq FROM pages WHERE {o.CLAIM} AND {o.t('hospital_name')} IS NOT NULL GROUP BY ALL"))
def o59(s: SparkSession, d: str) -> DataFrame:
    return consistency.value_pages(load(s, d, "pages"), "hospital_name", "claim").withColumn("pages", F.concat_ws(",", F.col("pages").cast("array<string>")))


@query("o60_facility_clusters", o.query([o.PAGES, o.FACILITIES], "SELECT claim_id, n_names, array_to_string(clusters, '|') AS clusters FROM clusters"))
def o60(s: SparkSession, d: str) -> DataFrame:
    return consistency.facility_clusters(load(s, d, "pages")).select("claim_id", "n_names", *joined("clusters"))


@query("o61_amount_audit", o.query([o.PAGES, o.AMOUNTS], "SELECT * FROM audit"))
def o61(s: SparkSession, d: str) -> DataFrame:
    return consistency.amount_audit(load(s, d, "pages"))


@query("o62_consistency_rollup", o.query([o.PAGES, *o.CONSISTENCY], "SELECT * FROM consistency"))
def o62(s: SparkSession, d: str) -> DataFrame:
    pages = load(s, d, "pages")
    return consistency.consistency_rollup(consistency.discrepancies(pages), load(s, d, "claims")).withColumn("details", F.concat_ws("; ", "details"))


@query("o81_extract_requirements", o.query([o.PAGES, o.REQUIREMENTS], "SELECT * FROM requirements"))
def o81(s: SparkSession, d: str) -> DataFrame:
    return evidence.extract_requirements(load(s, d, "pages"))


@query("o82_submissions", o.query([o.PAGES, o.SUBMITTED], "SELECT * FROM submitted"))
def o82(s: SparkSession, d: str) -> DataFrame:
    return evidence.submissions(load(s, d, "pages"))


_EVIDENCE = [o.PAGES, o.REQUIREMENTS, o.SUBMITTED, o.MATCHES]


def matches_of(pages: DataFrame) -> DataFrame:
    return evidence.match_evidence(evidence.extract_requirements(pages), evidence.submissions(pages))


@query("o46_match_evidence", o.query(_EVIDENCE, "SELECT * FROM matches"))
def o46(s: SparkSession, d: str) -> DataFrame:
    return matches_of(load(s, d, "pages"))


@query("o47_missing_evidence", o.query(_EVIDENCE, "SELECT claim_id, sr_no, document_title FROM matches WHERE missing"))
def o47(s: SparkSession, d: str) -> DataFrame:
    return evidence.missing_evidence(matches_of(load(s, d, "pages")))


@query("o53_check_page_refs", o.query([o.PAGES], "SELECT claim_id, page_seq AS sr_no, page_number + page_seq % 2 AS page_number FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.claim_id = p.claim_id AND q.page_number = p.page_number + p.page_seq % 2)"))
def o53(s: SparkSession, d: str) -> DataFrame:
    pages = load(s, d, "pages")
    cited = pages.select("claim_id", F.col("page_seq").alias("sr_no"), (F.col("page_number") + F.col("page_seq") % 2).alias("page_number"))
    return evidence.check_page_refs(cited, pages).select("claim_id", "sr_no", "page_number")


@query("o63_evidence_summary", o.query(_EVIDENCE, "SELECT claim_id, count(*) AS required, count(*) FILTER (WHERE NOT missing) AS present, count(*) FILTER (WHERE missing) AS missing_count FROM matches GROUP BY claim_id"))
def o63(s: SparkSession, d: str) -> DataFrame:
    return evidence.evidence_summary(matches_of(load(s, d, "pages")))


@query("o64_page_type_counts", o.query([o.PAGES], "SELECT claim_id, document_type, count(*) AS n_pages FROM pages GROUP BY ALL"))
def o64(s: SparkSession, d: str) -> DataFrame:
    return telemetry.page_type_counts(load(s, d, "pages"))


#: Columns of a page that no check of the verdict reads.
_UNREAD = ("file_seq", "source_file", "doctor_name", "diagnosis", "receipt_number", "paid_amount", "sum_insured", "premium_amount")


def status_of(s: SparkSession, d: str) -> DataFrame:
    """Everything the verdict needs. What the checks read of the pages is written once, in buckets of a
    claim; the checks group and join on that key and shuffle them no more."""
    pages, claims = bucketed(load(s, d, "pages").drop(*_UNREAD), "claim_id", "claim_pages"), load(s, d, "claims")
    return verdict.status_inputs(
        claims, pages, validate.validation_rollup(validate.validate_pages(validate.fill_context(pages))), validity_of(pages, claims),
        consistency.consistency_rollup(consistency.discrepancies(pages), claims), evidence.evidence_summary(matches_of(pages)),
    )


@query("o70_readiness_verdict", o.query(o.VERDICT_PARTS, o.VERDICT))
def o70(s: SparkSession, d: str) -> DataFrame:
    return verdict.readiness_verdict(status_of(s, d))
