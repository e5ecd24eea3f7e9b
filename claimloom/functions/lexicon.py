"""Default word lists, patterns and rules. Fixed values; every operator takes
them as arguments, so a caller can bring others."""

# Words that say nothing about which company is named.
COMPANY_NOISE = (
    "ltd", "limited", "co", "corp", "corporation", "inc", "incorporated",
    "insurance", "assurance", "company", "general", "health", "life",
    "mediclaim", "india", "services", "service", "tpa", "private", "pvt",
    "the", "and", "&", "of", "for", "verified", "direct", "contact", "other",
)
# Titles before a person's name.
PERSON_TITLES = ("mr", "mrs", "ms", "smt", "dr", "mast", "master", "shri", "kumari", "prof")
# Words that say nothing about which facility is named.
FACILITY_NOISE = (
    "hospital", "clinic", "center", "centre", "healthcare", "health", "care",
    "medical", "institute", "nursing", "home", "multispeciality", "speciality",
    "super", "city", "memorial", "charitable", "trust", "private", "ltd", "limited",
)
# Phrases that mark a claims administrator.
ADMINISTRATORS = (
    "tpa", "third party administrator", "t.p.a", "claims administrator",
    "medi assist", "vidal", "paramount", "raksha", "heritage", "mdindia",
    "fhpl", "ericson", "safeway", "health india", "family health plan",
)
# Words of a requirement that don't count for a match.
REQUIREMENT_STOP = ("and", "the", "of", "in", "for", "with", "or", "a", "an", "original", "copy", "duly", "stamped", "signed")
# A requirement with a word on the left is met by a submission that contains one on the right.
EVIDENCE_CATEGORIES = (
    (("discharge", "summary", "card"), ("discharge", "summary", "card")),
    (("bill", "final", "invoice", "tariff"), ("bill", "invoice", "receipt", "tariff")),
    (("admission", "indoor", "triage", "entry"), ("admission", "indoor", "triage", "entry")),
    (("receipt", "payment", "deposit", "settlement"), ("receipt", "payment", "deposit", "settlement")),
    (("pharmacy", "medicine", "chemist", "drug"), ("pharmacy", "medicine", "chemist", "drug")),
    (
        ("investigation", "lab", "pathology", "diagnostic", "report", "reports", "radiology", "ct", "mri", "x-ray", "scan", "scans", "ultrasound", "usg", "imaging", "sonography"),
        ("investigation", "lab", "pathology", "test", "radiology", "report", "reports", "diagnostic", "scan", "scans", "ultrasound", "usg", "imaging"),
    ),
    (("claim", "form"), ("claim", "form", "part-a", "part-b")),
    (("cheque", "cancelled", "passbook", "bank"), ("cheque", "passbook", "bank")),
    (("aadhar", "pan", "kyc", "identity", "id"), ("aadhar", "pan", "kyc", "identity", "id")),
    (("room", "rent", "boarding", "cov-002"), ("room", "rent", "boarding", "folio", "bill", "invoice", "charges")),
)
# Required fields of each page type, in the order of reports.
REQUIRED_FIELDS = {
    "insurance_policy": ("policy_number", "policy_start_date", "policy_end_date", "policy_holder_name"),
    "medical_bill": ("document_date", "bill_number", "patient_name", "bill_amount"),
    "invoice": ("document_date", "invoice_number", "patient_name", "bill_amount"),
    "medical_report": ("document_date", "patient_name", "hospital_name"),
    "hospital_document": ("document_date", "patient_name", "hospital_name"),
    "incident_document": ("document_date", "patient_name"),
}
# Words that make a policy line a requirement, and phrases that don't.
REQUIREMENT_WORDS = (
    "bill", "receipt", "discharge", "summary", "report", "certificate", "prescription", "claim form",
    "investigation", "id proof", "cheque", "fir", "police", "boarding pass", "ticket", "invoice",
)
REQUIREMENT_EXCLUDED = ("policy certificate", "policy schedule", "clause id", "admissible expenses", "statutory", "ombudsman")
TITLE_EXCLUDED = ("policy", "schedule", "clause id", "admissible")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Banners of a document, a policy section and a claim form, before a title.
# A word of each banner, in lower case.
BANNER_MARKS = ("document", "section", "claim")
BANNERS = (r"DOCUMENT\s*\d+\s*[:\-]", r"SECTION\s*[A-Z0-9]+(?:\s*\([^)]+\))?\s*[:\-]", r"CLAIM\s*FORM\s*[-—:]")
