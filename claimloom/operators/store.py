"""Claims, tool log, snapshots and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import distinct_in_order


def new_claims(claims: DataFrame) -> DataFrame:
    """Rows to append: file lists without blanks and repeats, status pending."""
    return claims.withColumn("claim_filenames", distinct_in_order(F.coalesce("claim_filenames", F.array().cast("array<string>")))).withColumn("status", F.lit("pending"))


def normalize_tool_log(log: DataFrame) -> DataFrame:
    """One shape for both kinds of record: success flag and duration."""
    ok = F.coalesce(F.col("status").isin("success", "PASS", "ok"), F.lit(False))
    return log.withColumn("success", ok).withColumn("duration", F.coalesce("execution_time_ms", "duration_ms", F.lit(0.0))).drop("execution_time_ms", "duration_ms")


def normalize_snapshots(snapshots: DataFrame) -> DataFrame:
    """Numeric step names become step_<n>."""
    s = F.col("step_name")
    return snapshots.withColumn("step_name", F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("step_"), s)).otherwise(s))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def upsert_reports(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest report of each claim, with the status its claim takes."""
    out = latest(current.unionByName(incoming), ["claim_id"], F.desc("created_on"), F.desc("seq"))
    return out.withColumn("claim_status", F.lit("completed"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, ["claim_id"], F.desc("id"))


def list_claims(claims: DataFrame, reports: DataFrame) -> DataFrame:
    return claims.join(reports.select("claim_id", "verdict", "missing_count", "validity_pass"), "claim_id", "left")


def claim_history(claims: DataFrame, log: DataFrame, reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per claim: ordered tool log, report, latest snapshot. Each side is
    aggregated before it is joined."""
    steps = log.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "tool_name"))), lambda x: x["tool_name"]).alias("tools"))
    last = latest_snapshot(snapshots).select("claim_id", F.col("step_name").alias("last_step"))
    out = claims.join(steps, "claim_id", "left").join(reports.select("claim_id", F.col("verdict").alias("report_verdict")), "claim_id", "left").join(last, "claim_id", "left")
    return out.select("claim_id", "status", F.coalesce("report_verdict", "status").alias("verdict"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), "last_step")


def delete_claims(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the claims in ids."""
    gone = ids.select("claim_id").distinct()
    return {name: df.join(gone, "claim_id", "left_anti") for name, df in tables.items()}


def repair_status(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Interrupted runs: in_progress becomes completed with a report, else pending."""
    has = reports.select("claim_id").distinct().withColumn("_has", F.lit(True))
    fixed = F.when(F.col("status") == "in_progress", F.when(F.col("_has"), "completed").otherwise("pending")).otherwise(F.col("status"))
    return claims.join(has, "claim_id", "left").withColumn("status", fixed).drop("_has")


def claims_page(claims: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; claim_id breaks ties."""
    return claims.orderBy(F.desc("created_on"), "claim_id").offset(offset).limit(limit)


def tool_log_ordered(log: DataFrame) -> DataFrame:
    return log.orderBy("claim_id", "id")
