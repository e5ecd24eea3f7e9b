"""Required against submitted evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimloom.functions import lexicon
from claimloom.functions.scalars import (
    clause_title,
    contains_any,
    first_json_object,
    let,
    loose_bool,
    loose_page_number,
    requirement_line,
    requirement_title,
    requirement_words,
    text,
    words,
)

# Status words of checklist rows.
PRESENT_STATUS = ("received", "found", "available", "present", "verified", "valid", "uploaded")
MISSING_STATUS = ("missing", "not_found", "unfulfilled", "pending", "required", "action_required")


def extract_requirements(pages: DataFrame, keywords: Sequence[str] = lexicon.REQUIREMENT_WORDS, excluded: Sequence[str] = lexicon.REQUIREMENT_EXCLUDED) -> DataFrame:
    """claim_id, sr_no, document_title, reason: of each policy page in order, lines of
    its conditions, then of its clauses, then of the text of its claims section.

    The first line of a title (in lower case) counts; numbers follow line order. A
    claim without any such line takes the titles of its clauses as they stand.
    """
    none = F.array().cast("array<string>")
    array = lambda c: F.coalesce(F.col(c), none) if c in pages.columns else none
    section = F.when(text("policy_relevant_text").isNotNull(), F.array("policy_relevant_text")).otherwise(none) if "policy_relevant_text" in pages.columns else none
    lines = F.flatten(F.transform(F.concat(array("relevant_conditions"), array("policy_clauses"), section), lambda c: F.split(c, r"[\n\r;]+")))
    read = lambda kind, reason, title: F.struct(F.lit(kind).alias("kind"), reason.alias("reason"), title.alias("document_title"))
    rows = F.concat(F.transform(lines, lambda x: read(0, requirement_line(x), requirement_title(x))), F.transform(array("policy_clauses"), lambda x: read(1, x, clause_title(x))))
    # worked out before lines become rows: a filter on rows would work each out again for every phrase
    rows = F.transform(rows, lambda x: F.struct(x["kind"].alias("kind"), x["reason"].alias("reason"), x["document_title"].alias("document_title"), F.lower(x["reason"]).alias("low"), F.lower(x["document_title"]).alias("low_title")))
    own = pages.filter(F.col("document_type") == "insurance_policy").select("claim_id", "page_seq", F.posexplode(rows).alias("at", "row"))
    own = own.select("claim_id", "page_seq", "at", "row.*")
    low, title = F.col("low"), F.col("low_title")
    keep = (F.length("reason") >= 4) & contains_any(low, keywords) & ~contains_any(low, excluded) & ~contains_any(title, lexicon.TITLE_EXCLUDED)
    order = ["page_seq", "at"]
    same = Window.partitionBy("claim_id", "kind", "low_title").orderBy(*order)
    own = own.filter(((F.col("kind") == 0) & keep) | ((F.col("kind") == 1) & (F.col("document_title") != "")))
    own = own.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    own = own.withColumn("first_kind", F.min("kind").over(Window.partitionBy("claim_id"))).filter("kind = first_kind")
    return own.select("claim_id", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order)).alias("sr_no"), "document_title", "reason")


def submissions(pages: DataFrame) -> DataFrame:
    """Claim pages with a title: their own, or their type in words."""
    own = pages.filter(~F.col("document_type").eqNullSafe("insurance_policy"))
    derived = F.concat(F.initcap(F.replace(F.col("document_type"), F.lit("_"), F.lit(" "))), F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")"))
    return own.select("claim_id", "page_seq", "page_number", "document_type", F.coalesce(text("document_title"), derived).alias("document_title"))


def _categories(holds: list[Column]) -> Column:
    """The categories that hold, one bit each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(holds):
        out = out.bitwiseOR(F.when(c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def requirement_categories(need: Column) -> Column:
    """Evidence categories that a requirement's words ask for."""
    return _categories([F.arrays_overlap(need, F.array(*map(F.lit, left))) for left, _ in lexicon.EVIDENCE_CATEGORIES])


def submission_categories(title: Column) -> Column:
    """Evidence categories that a submitted title, in lower case, belongs to."""
    return _categories([contains_any(title, right) for _, right in lexicon.EVIDENCE_CATEGORIES])


def match_evidence(requirements: DataFrame, submitted: DataFrame) -> DataFrame:
    """Each requirement with the first submission that meets it, if any. A claim has one requirement a number.

    An empty title is part of any text: it stops the walk and meets nothing.
    """
    r = requirements.select("claim_id", "sr_no", F.col("document_title").alias("requirement"))
    s = submitted.select("claim_id", "page_seq", "page_number", F.trim(F.coalesce("document_title", F.lit(""))).alias("submission"))
    # words and categories are taken before titles meet, once for each title
    asked = r.withColumns({"r": F.lower("requirement"), "need": requirement_words(F.lower("requirement"))}).withColumn("asks", requirement_categories(F.col("need")))
    given = s.withColumn("s", F.lower("submission")).withColumn("held", F.array_distinct(words(F.col("s")))).withColumn("gives", submission_categories(F.col("s")))
    shared = F.size(F.array_intersect("need", "held"))
    meets = (F.col("asks").bitwiseAND(F.col("gives")) != 0) | F.col("s").contains(F.col("r")) | F.col("r").contains(F.col("s")) | (shared >= 2) | ((F.size("need") == 1) & (shared == 1))
    # one join keeps the requirements that nothing meets; all of it goes by claim
    both = asked.join(given.withColumnRenamed("claim_id", "s_claim"), (F.col("claim_id") == F.col("s_claim")) & meets, "left")
    out = both.groupBy("claim_id", "sr_no", "requirement").agg(F.min_by(F.struct("page_number", "submission"), "page_seq").alias("hit"))
    ok = F.coalesce((F.col("hit.submission") != "") & F.col("hit.page_number").isNotNull(), F.lit(False))
    return out.select("claim_id", "sr_no", F.col("requirement").alias("document_title"), (~ok).alias("missing"), F.when(ok, F.col("hit.page_number")).alias("page_number"), F.when(ok, F.col("hit.submission")).alias("matched_title"))


def missing_evidence(matches: DataFrame) -> DataFrame:
    return matches.filter("missing").select("claim_id", "sr_no", "document_title")


def evidence_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("claim_id").agg(F.count("*").alias("required"), F.count_if(~F.col("missing")).alias("present"), F.count_if("missing").alias("missing_count"))


def check_page_refs(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """Matches whose page isn't one of the claim's pages."""
    own = pages.select("claim_id", "page_number").distinct()
    return matches.filter("page_number IS NOT NULL").join(own, ["claim_id", "page_number"], "left_anti")


def is_missing(missing: Column, status: Column, page: Column) -> Column:
    """A loosely typed checklist row: explicit flag, then status, then page."""
    flag, state = F.lower(F.coalesce(missing, F.lit(""))), F.lower(F.trim(F.coalesce(status, F.lit(""))))
    has_page = F.coalesce(loose_page_number(page).isNotNull(), F.lit(False))
    no_page = page.isNull() | page.isin("", "null")
    return F.when((flag == "false") | state.isin(*PRESENT_STATUS) | has_page, False).when((flag == "true") | state.isin(*MISSING_STATUS), True).otherwise(no_page)


def checklist_split(checklist: DataFrame) -> DataFrame:
    """Per claim: submitted and missing titles of a checklist, in order."""
    gone = is_missing(F.col("missing"), F.col("status"), F.col("page"))
    rows = checklist.withColumn("_gone", gone)
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("sr_no", "title")))), lambda x: x["title"])
    return rows.groupBy("claim_id").agg(pick(~F.col("_gone")).alias("submitted"), pick(F.col("_gone")).alias("missing"))


_ITEM = "struct<sr_no:string,document_title:string,missing:string,page_number:string,page_no:string,matched_submitted_document:string>"


def validate_responses(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of stored JSON responses with a reason where they are no good.

    claim_id, sr_no, document_title, missing, page_number, problem. A response
    without a result list gives one row with sr_no 0; a bare array is a result list.
    """
    parsed = F.from_json(first_json_object("response_json"), f"document_results array<{_ITEM}>, missing_documents array<{_ITEM}>")
    rows = responses.select("claim_id", let(parsed, lambda p: F.coalesce(p["document_results"], p["missing_documents"])).alias("items"))
    # one pass: a response without a list goes on as one row without an item
    items = rows.withColumn("none", F.col("items").isNull()).select("claim_id", "none", F.posexplode_outer("items").alias("k", "i")).filter("none OR k IS NOT NULL")
    raw_page = F.coalesce("i.page_number", "i.page_no")
    items = items.select("claim_id", "none", F.when(F.col("none"), 0).otherwise(F.col("k") + 1).alias("sr_no"), F.col("i.document_title").alias("document_title"), loose_bool("i.missing").alias("missing"), loose_page_number(raw_page).alias("page_number"), (raw_page.isNotNull() & ~raw_page.isin("", "null")).alias("given"))
    own = pages.select("claim_id", "page_number").distinct().withColumn("known", F.lit(True))
    items = items.join(own, ["claim_id", "page_number"], "left")
    problem = (
        F.when(F.col("none"), "no result list").when(text("document_title").isNull(), "no title")
        .when(F.col("missing").isNull(), "missing is no boolean")
        .when(F.col("missing") & F.col("given"), "missing with a page")
        .when(~F.col("missing") & F.col("page_number").isNull(), "present without a page")
        .when(~F.col("missing") & F.col("known").isNull(), "page not submitted")
    )
    return items.select("claim_id", "sr_no", "document_title", "missing", "page_number", problem.alias("problem"))


def split_responses(validated: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good and quarantined items, both stored under path by one pass, and their counts.

    The counts (items, good, quarantined) are observed while the rows are written.
    """
    spark, seen = validated.sparkSession, Observation("responses")
    good = F.col("problem").isNull()
    rows = validated.withColumn("outcome", F.when(good, "good").otherwise("quarantined"))
    rows.observe(seen, F.count("*").alias("items"), F.count_if(good).alias("good"), F.count_if(~good).alias("quarantined")).write.partitionBy("outcome").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.filter("outcome = 'good'").drop("outcome", "problem"), stored.filter("outcome = 'quarantined'").drop("outcome"), seen.get
