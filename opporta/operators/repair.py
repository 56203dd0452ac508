"""Repair proposals from stored snapshots, and recovery of interrupted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import text as tx
from opporta.operators.rule_based import organization_name

# Names that mean "no organization found".
PLACEHOLDERS = ["", "đang cập nhật", "đang chờ ai bóc tách", "không rõ", "n/a", "null"]
HEARTBEAT_SECONDS = 20


def snapshot_leads(leads: DataFrame, snapshots: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Leads with their stored page, matched on the snapshot reference.

    A page fetched twice on one day has two snapshots with one reference. `also` names columns of both sides that tell them apart
    (a null matches a null); without it such a lead meets every snapshot of its reference.
    """
    own = [f"_{c}" for c in also]
    pages = snapshots.select(F.col("snapshot_path").alias("raw_content_ref"), *[F.col(c).alias(o) for c, o in zip(also, own, strict=True)],
                             *[c for c in snapshots.columns if c not in ("snapshot_path", "source_id", "day", *also)])
    same = leads["raw_content_ref"] == pages["raw_content_ref"]
    for c, o in zip(also, own, strict=True):
        same = same & leads[c].eqNullSafe(pages[o])
    return leads.join(pages, same).drop(pages["raw_content_ref"], *own)


def repair_report(leads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Proposed changes per lead. parsed: raw_content_ref, parsed_title, parsed_content, parsed_published_at.

    A stored time with microseconds and no evidence on the page is the old crawl-time default and is
    nulled. The organization is re-read when the page has a labelled owner or the stored name is a placeholder.
    """
    joined = leads.join(parsed, "raw_content_ref", "left").withColumn("outcome", F.when(F.col("parsed_content").isNull(), "missing snapshot"))
    stored, fresh = F.col("published_at"), F.col("parsed_published_at")
    fraction = F.expr("extract(SECOND FROM published_at)") % 1 != 0
    date_change = F.when(fresh.isNotNull(), ~fresh.eqNullSafe(stored)).otherwise(stored.isNotNull() & F.coalesce(fraction, F.lit(False)))
    reread = F.col("parsed_content").startswith("Chủ đầu tư:") | F.lower(F.trim(F.coalesce("organization_name", F.lit("")))).isin(*PLACEHOLDERS)
    named = joined.withColumn("_org", F.when(reread, organization_name(F.col("parsed_title"), F.col("parsed_content"))))
    org_change = F.col("_org").isNotNull() & ~F.col("_org").eqNullSafe(F.col("organization_name"))
    report = named.withColumns({"date_changed": F.coalesce(date_change & F.col("outcome").isNull(), F.lit(False)), "organization_changed": org_change})
    return report.select(
        "id", "title", F.coalesce("outcome", F.when(F.col("date_changed") | F.col("organization_changed"), "changed").otherwise("same")).alias("outcome"),
        "date_changed", F.col("published_at").alias("published_from"), F.when(F.col("date_changed"), fresh).otherwise(stored).alias("published_to"),
        "organization_changed", F.col("organization_name").alias("organization_from"),
        F.when(F.col("organization_changed"), F.col("_org")).otherwise(F.col("organization_name")).alias("organization_to"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("scanned"), F.count_if(F.col("outcome") == "changed").alias("changed"),
                      F.count_if(F.col("outcome") == "missing snapshot").alias("skipped"))


def apply_repair(leads: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    todo = report.where("outcome = 'changed'").select("id", "published_to", "organization_to", F.lit(True).alias("_c"))
    return leads.join(todo, "id", "left").withColumns({
        "published_at": F.when(F.col("_c"), F.col("published_to")).otherwise(F.col("published_at")),
        "organization_name": F.when(F.col("_c"), F.col("organization_to")).otherwise(F.col("organization_name")),
        "updated_at": F.when(F.col("_c"), now).otherwise(F.col("updated_at"))}).drop("published_to", "organization_to", "_c")


def recover_runs(runs: DataFrame, now: Column, heartbeat: Column | None = None) -> DataFrame:
    """RUNNING runs become INTERRUPTED when the worker's heartbeat is missing or too old."""
    stale = F.lit(True) if heartbeat is None else F.coalesce(
        F.timestamp_diff("MICROSECOND", heartbeat, now) > HEARTBEAT_SECONDS * 1_000_000, F.lit(True))
    hit = (F.col("status") == "RUNNING") & stale
    return runs.withColumns({
        "end_time": F.when(hit, now).otherwise(F.col("end_time")),
        "error_message": F.when(hit, "Backend khởi động lại khi crawl chưa hoàn tất").otherwise(F.col("error_message")),
        "status": F.when(hit, "INTERRUPTED").otherwise(F.col("status"))})


def requeue_jobs(jobs: DataFrame) -> DataFrame:
    """RUNNING jobs go back to the queue after a worker restart."""
    hit = F.col("status") == "RUNNING"
    none = F.lit(None)
    return jobs.withColumns({
        "started_at": F.when(hit, none).otherwise(F.col("started_at")), "worker_id": F.when(hit, none).otherwise(F.col("worker_id")),
        "error_message": F.when(hit, "Worker trước đã dừng; job được đưa lại vào hàng đợi").otherwise(F.col("error_message")),
        "status": F.when(hit, "QUEUED").otherwise(F.col("status"))})


def interrupted_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources to mark INTERRUPTED: those of recovered runs and those still marked RUNNING."""
    return sources.where("status = 'RUNNING'").select("id").unionByName(
        runs.where("status = 'RUNNING'").select(F.col("source").alias("id"))).distinct()
