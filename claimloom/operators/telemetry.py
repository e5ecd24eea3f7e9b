"""Counts, activity and audits of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_type_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("claim_id", "document_type").agg(F.count("*").alias("n_pages"))


def portfolio_kpis(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: claims, files, and claims that need action or are ready, both by
    status (a finished claim's status never says ready) and by verdict."""
    s = F.lower(F.coalesce("status", F.lit("")))
    v = F.coalesce("verdict", F.lit(""))
    files = F.when(F.col("policy_filename").isNotNull(), 1).otherwise(0) + F.coalesce(F.size("claim_filenames"), F.when(F.col("claim_filename").isNotNull(), 1).otherwise(0))
    rows = claims.join(reports.select("claim_id", "verdict"), "claim_id", "left")
    return rows.agg(
        F.count("*").alias("n_claims"), F.sum(files).alias("n_files"),
        F.count_if(s.contains("missing") | s.contains("action_required")).alias("action_by_status"), F.count_if(s.contains("ready")).alias("ready_by_status"),
        F.count_if(v.startswith("ACTION_REQUIRED")).alias("action_by_verdict"), F.count_if(v == "CLAIM_READY_FOR_SUBMISSION").alias("ready_by_verdict"),
    )


def tool_activity(log: DataFrame) -> DataFrame:
    return log.groupBy("claim_id").agg(F.count("*").alias("n_runs"), F.countDistinct("tool_name").alias("n_tools"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"), F.sum("duration").alias("duration"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "nr") -> DataFrame:
    """1-based numbers within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def repetition_audit(log: DataFrame, n: int = 3) -> DataFrame:
    """Steps whose tool was also each of the n steps before."""
    w = Window.partitionBy("claim_id").orderBy("id")
    same = F.lit(True)
    for k in range(1, n + 1):
        same = same & (F.lag("tool_name", k).over(w) == F.col("tool_name"))
    return log.withColumn("repeated", F.coalesce(same, F.lit(False))).filter("repeated").drop("repeated")


def retry_audit(log: DataFrame, max_retries: int = 1) -> DataFrame:
    """Steps beyond the allowed retries of a tool in a claim's run."""
    w = Window.partitionBy("claim_id", "tool_name").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("attempt", F.count("*").over(w)).filter(F.col("attempt") > max_retries + 1)


def recent(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
