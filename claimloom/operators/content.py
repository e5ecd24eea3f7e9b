"""Content classification of documents with evidence, and page types."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.lexicon import BANNER_MARKS, BANNERS
from claimloom.functions.scalars import contains_any, found

# Signal patterns by family, over lower-case text.
FAMILIES = {
    "policy": (
        (r"\b(?:policy\s*schedule|schedule\s*of\s*insurance|certificate\s*of\s*insurance|policy\s*certificate|policy\s*wording|policy\s*contract|terms\s*and\s*conditions\s*of\s*insurance)\b", "contract_schedule_heading"),
        (r"\b(?:certified\s*policy|schedule\s*of\s*premium|insurance\s*product\s*information|proposer\s*and\s*policy\s*details|section\s*a[:\-]\s*policy\s*schedule)\b", "policy_section_heading"),
        (r"\b(?:sum\s*insured|basic\s*sum\s*insured|coverage\s*limit|total\s*sum\s*insured|sum\s*assured)\b", "sum_insured_provision"),
        (r"\b(?:policy\s*period|period\s*of\s*insurance|policy\s*inception|policy\s*commencement|policy\s*expiry)\b", "coverage_period_provision"),
        (r"\b(?:gross\s*premium|net\s*premium|total\s*premium|premium\s*rate|annual\s*premium)\b", "premium_structure_provision"),
        (r"\b(?:proposer|policyholder|policy\s*holder)\b", "policyholder_role"),
        (r"\b(?:insured\s*persons?|insured\s*members?|covered\s*persons?|beneficiar(?:y|ies))\b", "insured_members_role"),
        (r"\b(?:deductible|cumulative\s*bonus|no\s*claim\s*bonus|co-?payment|nil\s*co-?payment)\b", "cost_sharing_terms"),
        (r"\b(?:waiting\s*period|statutory\s*waiting|pre-existing\s*diseases?\s*waiting)\b", "waiting_period_clause"),
        (r"\b(?:general\s*exclusions|policy\s*exclusions|non-indemnifiable\s*expenses)\b", "exclusions_clause"),
        (r"\b(?:claim\s*filing\s*requirements|mandatory\s*evidence|claim\s*submission\s*procedure)\b", "claims_procedure_clause"),
        (r"\b(?:underwritten\s*by|irda\s*registration|uin\s*[:\-]|stamp\s*duty|inpatient\s*benefit\s*plan|health\s*insurance\s*policy|travel\s*insurance\s*policy|motor\s*insurance\s*policy)\b", "underwriting_regulatory_mark"),
        (r"\b(?:health\s*insurance\s*provider|insurance\s*provider|general\s*insurance\s*services|policy\s*kit|health\s*cards?|mediclaim\s*insurance)\b", "insurance_service_indicators"),
        (r"\b(?:agent\s*name|agent\s*code|intermediary\s*name|broker\s*code|intermediary\s*code)\b", "insurance_intermediary_role"),
        (r"\b(?:policy\s*no[\s.:]|policy\s*number[\s.:]|certificate\s*no[\s.:]|certificate\s*number[\s.:])\b", "policy_number_present"),
        (r"\b(?:policy\s*(?:number|no\.?|certificate\s*no\.?|num)|certificate\s*number)[\s:\-]+([0-9a-zA-Z/._'-]+)", "policy_number_present"),
    ),
    "clinical": (
        (r"\b(?:discharge\s*summary|discharge\s*card|clinical\s*summary|indoor\s*admission|ipd\s*record|ipd\s*admission|uhid)\b", "clinical_admission_discharge"),
        (r"\b(?:chief\s*complaints|history\s*of\s*present\s*illness|clinical\s*findings|physical\s*examination|provisional\s*diagnosis|final\s*diagnosis)\b", "clinical_diagnosis_history"),
        (r"\b(?:treating\s*doctor|consulting\s*surgeon|attending\s*physician|operating\s*surgeon|anesthetist|consultant\s*pathologist)\b", "treating_physician_role"),
        (r"\b(?:operation\s*notes|surgical\s*record|procedure\s*performed|course\s*in\s*hospital|condition\s*at\s*discharge|treatment\s*given)\b", "surgical_hospital_notes"),
        (r"\b(?:prescription|rx\s*[:\-]|dosage|medication\s*advised|follow-?up\s*advice|tab\.|syr\.|inj\.)\b", "prescription_medication"),
    ),
    "billing": (
        (r"\b(?:inpatient\s*bill|inpatient\s*tax\s*invoice|final\s*hospital\s*bill|hospital\s*medical\s*bill|pharmacy\s*tax\s*invoice)\b", "hospital_tax_invoice"),
        (r"\b(?:official\s*settlement\s*&\s*payment\s*receipt|cash\s*counter\s*receipt|interim\s*bill|discharge\s*bill)\b", "cashier_settlement_receipt"),
        (r"\b(?:room\s*rent|boarding\s*charges|nursing\s*charges|icu\s*charges|ot\s*charges|investigation\s*charges|pharmacy\s*charges)\b", "itemized_hospital_charges"),
        (r"\b(?:total\s*bill\s*amount|net\s*payable|amount\s*received|balance\s*due|hospital\s*gstin|ipd\s*no)\b", "hospital_billing_totals"),
    ),
    "diagnostic": (
        (r"\b(?:pathology\s*laboratory|radiology\s*ultrasound|diagnostic\s*scan|laboratory\s*investigation|blood\s*examination|biochemistry\s*report)\b", "lab_investigation_heading"),
        (r"\b(?:biological\s*reference\s*interval|observed\s*value|specimen|impression|radiologist\s*impression|histopathology)\b", "lab_test_findings"),
    ),
    "incident": ((r"\b(?:first\s*information\s*report|police\s*station|fir\s*no|theft\s*report|incident\s*documentation)\b", "police_incident_record"),),
    "unrelated": (
        (r"\b(?:employment\s*agreement|employment\s*contract|job\s*description|employee\s*duties|salary\s*breakup|ctc\s*per\s*annum)\b", "employment_contract"),
        (r"\b(?:non-disclosure\s*agreement|confidentiality\s*agreement|nda\s*effective\s*date|receiving\s*party|disclosing\s*party)\b", "nda_agreement"),
        (r"\b(?:software\s*license\s*agreement|terms\s*of\s*service|end\s*user\s*license|lease\s*deed|tenancy\s*agreement|tenant|landlord)\b", "general_legal_contract"),
        (r"\b(?:curriculum\s*vitae|resume|work\s*experience|education\s*qualifications|technical\s*skills)\b", "resume_cv"),
    ),
}
# Signals of the four pillars of a policy.
PILLARS = (
    ("contract_schedule_heading", "policy_section_heading", "underwriting_regulatory_mark", "insurance_service_indicators"),
    ("sum_insured_provision", "coverage_period_provision", "premium_structure_provision", "cost_sharing_terms"),
    ("policyholder_role", "insured_members_role", "policy_number_present", "insurance_intermediary_role"),
    ("waiting_period_clause", "exclusions_clause", "claims_procedure_clause"),
)


#: Patterns that are looked for as one first.
_TOGETHER = 6


def pattern_bits(families: list[list[str]]) -> Callable[[pa.Array], list[np.ndarray]]:
    """A function that gives for each family a number for each text, with a bit for each pattern found.

    A few patterns are looked for as one; only texts that hold one of them are asked for each."""
    every = [(f, k, p) for f, of in enumerate(families) for k, p in enumerate(of)]

    def bits(low: pa.Array) -> list[np.ndarray]:
        out = [np.zeros(len(low), dtype=np.int64) for _ in families]
        for a in range(0, len(every), _TOGETHER):
            some = every[a : a + _TOGETHER]
            hold = pc.match_substring_regex(low, "|".join(f"(?:{p})" for _, _, p in some)).fill_null(False)
            at = np.flatnonzero(np.asarray(hold))
            if not len(at):
                continue
            own = low.take(pa.array(at))
            for f, k, p in some:
                out[f][at] |= np.asarray(pc.match_substring_regex(own, p), dtype=np.int64) << k
        return out

    return bits


def with_signals(docs: DataFrame, families=FAMILIES) -> DataFrame:
    """Adds one array of found signals for each family.

    All patterns run in one pass over Arrow batches by an engine of linear time
    (`pattern_bits`). A vertical tab is no blank between words."""
    bits = pattern_bits([[p for p, _ in of] for of in families.values()])

    @F.arrow_udf("array<long>")
    def masks(low: pa.Array) -> pa.Array:
        columns = bits(low)
        flat = np.stack(columns, axis=1).reshape(-1) if columns else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, max(len(columns), 1), dtype=np.int32)[: len(low) + 1], flat)

    def signals(at: int, of) -> F.Column:
        return F.array_compact(F.array(*(F.when(F.getbit(F.col("_masks")[at], F.lit(k)) == 1, F.lit(kind)) for k, (_, kind) in enumerate(of))))

    docs = docs.withColumn("_masks", masks(F.lower("text")))
    return docs.withColumns({f"{name}_signals": signals(i, of) for i, (name, of) in enumerate(families.items())}).drop("_masks")


def classify_content(docs: DataFrame, families=FAMILIES) -> DataFrame:
    """Adds content_type, decision and confidence to documents with text."""
    docs = with_signals(docs, families)
    n = {k: F.size(f"{k}_signals") for k in families}
    medical = n["clinical"] + n["billing"] + n["diagnostic"]
    has = [F.arrays_overlap("policy_signals", F.array(*map(F.lit, p))) for p in PILLARS]
    pillars = sum((h.cast("int") for h in has[1:]), has[0].cast("int"))
    proven = ((has[0] & (has[1] | has[2] | (n["policy"] >= 2))) | ((pillars >= 2) & (n["policy"] >= 2))) & (medical <= n["policy"])
    main = F.when(n["billing"] >= F.greatest(n["clinical"], n["diagnostic"]), "medical_bill").when(n["diagnostic"] >= n["clinical"], "medical_report").otherwise("hospital_document")
    more = lambda k: (n[k] >= 2) & (n[k] > n["policy"])
    ladder = (
        (more("unrelated"), F.lit("unrelated_document"), "not_a_policy", F.lit(0.92)),
        (more("incident"), F.lit("incident_document"), "not_a_policy", F.lit(0.90)),
        ((n["diagnostic"] >= 2) & (n["diagnostic"] >= n["policy"]), F.lit("medical_report"), "not_a_policy", F.lit(0.95)),
        (more("billing"), F.lit("medical_bill"), "not_a_policy", F.lit(0.95)),
        (more("clinical"), F.lit("hospital_document"), "not_a_policy", F.lit(0.95)),
        ((medical >= 3) & (medical > 1.5 * n["policy"]), main, "not_a_policy", F.lit(0.92)),
        (proven, F.lit("insurance_policy"), "valid_policy", F.round(F.least(F.lit(0.99), 0.70 + pillars * 0.07 + n["policy"] * 0.02), 2)),
        (n["policy"] >= 1, F.lit("uncertain_document"), "uncertain", F.lit(0.40)),
    )
    kind, decision, confidence = F.lit("unrelated_document"), F.lit("not_a_policy"), F.lit(0.15)
    for cond, a, b, c in reversed(ladder):
        kind, decision, confidence = F.when(cond, a).otherwise(kind), F.when(cond, b).otherwise(decision), F.when(cond, c).otherwise(confidence)
    return docs.withColumn("content_type", kind).withColumn("decision", decision).withColumn("confidence", confidence)


def accept_policy(classified: DataFrame) -> DataFrame:
    """Adds accepted and, where not, a rejection code."""
    ok = F.col("decision") == "valid_policy"
    code = F.when(ok, None).when(F.col("decision") == "uncertain", "uncertain_policy").when(F.col("content_type").isin("medical_bill", "medical_report", "hospital_document"), "medical_document_in_policy_slot").otherwise("not_an_insurance_policy")
    return classified.withColumn("accepted", ok).withColumn("rejection", code)


def classify_pages(pages: DataFrame) -> DataFrame:
    """Adds page_type from text, banner and file name, an ordered CASE; unknown without text."""
    low, name, x = F.col("_low"), F.col("_name"), F.col("text")
    # columns of their own, so that each is worked out once
    out = pages.withColumns({"_low": F.lower(F.coalesce("text", F.lit(""))), "_name": F.lower(F.coalesce("source_file", F.lit("")))})
    out = out.withColumns({f"_banner{k}": found(F.when(low.contains(m), x), rf"(?im)^\s*{b}\s*([^\n\r]+)") for k, (b, m) in enumerate(zip(BANNERS, BANNER_MARKS, strict=True))})
    has = lambda *p: contains_any(low, p)
    # The phrases of each type.
    policy = (
        has("certified policy", "policy schedule", "schedule of insurance", "certificate of insurance", "policy certificate", "policy wording", "terms and conditions of insurance")
        | (has("policy number", "policy no", "policy #", "policy:") & has("sum insured", "proposer", "policyholder", "waiting period", "schedule of insurance", "gross premium", "period of insurance", "valid from", "insurer") & ~has("hospital:", "ipd record", "ipd admission", "tax invoice", "cashier receipt"))
        | (has("health plan", "sum insured", "proposer details", "coverage details", "elevate") & has("policy period", "waiting period", "exclusion", "benefit", "premium", "valid from") & ~has("tax invoice", "ipd no", "bill amount", "discharge summary", "chief complaints", "investigation charges"))
        | (name.contains("policy") & ~has("tax invoice", "discharge summary", "chief complaints", "investigation charges", "lab report"))
    )
    document, section = F.col("_banner0"), F.col("_banner1")
    title = F.lower(document)
    of_banner = (
        F.when(contains_any(title, ("diagnostic", "pathology", "scan report", "ultrasound", "radiology", "laboratory")), "medical_report")
        .when(contains_any(title, ("tax invoice", "receipt", "medical bill", "pharmacy tax", "final inpatient")), "medical_bill")
        .otherwise("hospital_document")
    )
    kind = (
        F.when(F.trim(low) == "", "unknown")
        .when(section.isNotNull() | policy, "insurance_policy")
        .when(document.isNotNull(), of_banner)
        .when(has("first information report", "police station", "incident report", "report number: fir", "theft of travel", "police seal"), "incident_document")
        .when(has("pathology laboratory", "radiology ultrasound", "diagnostic ultrasound scan report", "pathology report"), "medical_report")
        .when(has("hospital medical bill", "final inpatient tax invoice", "pharmacy tax invoice", "official settlement & payment receipt", "tax invoice & cov-002"), "medical_bill")
        .when(has("hospital", "discharge summary", "discharge card", "clinical summary", "indoor admission", "ward rounds", "consulting surgeon", "operation notes"), "hospital_document")
        .otherwise("other")
    )
    return out.withColumn("page_type", kind).drop("_low", "_name", *(f"_banner{k}" for k in range(len(BANNERS))))
