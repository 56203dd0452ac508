"""Operations views: sources, runs, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opporta.functions import dates, labels
from opporta.plans.dashboard import source_counts

RECENT_SECONDS = 600


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per source (ties by id)."""
    rest = [c for c in runs.columns if c != "source"]
    return runs.groupBy("source").agg(F.max_by(F.struct(*rest), F.struct("start_time", "id")).alias("r")).select("source", "r.*")


def source_overview(sources: DataFrame, leads: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each source with its counts, last run and the active job that concerns it.

    Four grouped passes joined once instead of four look-ups per source. A job without source concerns
    every source: the earliest such job is one row, compared with the source's own earliest job.
    """
    active = jobs.where(F.col("status").isin("QUEUED", "RUNNING")).select("source_id", F.struct("requested_at", "id", "status").alias("j"))
    own = active.where("source_id IS NOT NULL").groupBy("source_id").agg(F.min("j").alias("own_job"))
    # One row: the earliest job over all sources, beside each source.
    shared = active.where("source_id IS NULL").agg(F.min("j").alias("shared_job"))
    last = latest_runs(runs).select(F.col("source").alias("id"), F.col("status").alias("run_status"), F.col("start_time").alias("last_crawl_at"))
    joined = (
        sources.join(source_counts(leads).withColumnRenamed("source", "id"), "id", "left").join(last, "id", "left")
        .join(own.withColumnRenamed("source_id", "id"), "id", "left").withColumn("shared_job", shared.scalar()))
    job = F.least("own_job", "shared_job")
    return joined.select(
        "id", "name", "enabled", F.coalesce("total_leads", F.lit(0)).alias("total_leads"), F.coalesce("hot_leads", F.lit(0)).alias("hot_leads"),
        "last_crawl_at", F.coalesce(job["status"], F.col("run_status"), F.col("status")).alias("runtime_status"),
        F.when(F.col("adapter_mode") == "specialized", "P0").otherwise("CUSTOM").alias("priority"))


def with_job_labels(jobs: DataFrame, sources: DataFrame, everything: str = labels.ALL_SOURCES) -> DataFrame:
    """Source name (a default for jobs over all or unknown sources), window and trigger labels, local times."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return jobs.join(names, "source_id", "left").withColumns({
        "source_name": F.coalesce("source_name", F.lit(everything)), "timeframe_label": labels.mapped(F.col("timeframe"), labels.TIMEFRAMES),
        "trigger_label": labels.mapped(F.col("trigger"), labels.TRIGGERS), "requested_local": dates.to_local(F.col("requested_at"))})


def queue_view(jobs: DataFrame, sources: DataFrame, limit: int = 20) -> DataFrame:
    """Waiting jobs, oldest first, with their place in line. The top-k comes before the numbering."""
    waiting = jobs.where(F.col("status").isin("QUEUED", "PAUSED")).orderBy("requested_at", "id").limit(limit)
    numbered = waiting.withColumn("place", F.row_number().over(W.orderBy("requested_at", "id")))
    return with_job_labels(numbered, sources).select(
        "id", "place", "status", "source_id", "source_name", "timeframe", "timeframe_label", "trigger_label", "requested_local")


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("QUEUED", "PAUSED")).alias("queue_depth"),
                    *[F.count_if(F.col("status") == s).alias(s.lower()) for s in
                      ("QUEUED", "RUNNING", "PAUSED", "SUCCESS", "PARTIAL", "FAILED", "INTERRUPTED")])


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest jobs, 1 to 100; a result that is not a JSON object reads as null."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("result_json")).startswith("OBJECT"), F.lit(False))
    return jobs.orderBy(F.col("requested_at").desc_nulls_last(), "id").limit(max(1, min(limit, 100))).withColumn(
        "result_json", F.when(is_object, F.col("result_json")))


def current_activity(jobs: DataFrame, runs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """What is going on: a running or paused job, else a running run, else a queued job, else a job that
    ended less than ten minutes ago. One pass over each table; the smallest (tier, order) wins."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    status, job = F.col("status"), ["id", "source_id", "status", "trigger", "timeframe"]
    tier = (F.when(status.isin("RUNNING", "PAUSED"), 1).when(status == "QUEUED", 3)
            .when(status.isin("SUCCESS", "PARTIAL", "FAILED", "INTERRUPTED"), 4))
    at = F.when(tier == 1, F.col("started_at")).when(tier == 3, F.col("requested_at")).otherwise(F.col("completed_at"))
    first = F.when(tier == 3, micros(at)).otherwise(-micros(at))
    best_jobs = jobs.where(tier.isNotNull()).groupBy(tier.alias("tier")).agg(
        F.min_by(F.struct(*job, at.alias("at")), F.struct(F.coalesce(first, F.lit(2**62)), "id")).alias("c")).select("tier", "c.*")
    running = runs.where("status = 'RUNNING'").agg(
        F.max_by(F.struct("id", "source", "start_time"), F.struct("start_time", "id")).alias("c"), F.count("*").alias("n")).where("n > 0")
    best_run = running.select(
        F.lit(2).alias("tier"), F.col("c.id").alias("id"), F.col("c.source").alias("source_id"), F.lit("RUNNING").alias("status"),
        F.lit("CLI").alias("trigger"), F.lit("1_week").alias("timeframe"), F.col("c.start_time").alias("at"))
    seconds = F.greatest(F.lit(0), F.floor((micros(now) - micros(F.col("at"))) / 1_000_000)).cast("bigint")
    # At most one row per tier from here on.
    fresh = best_jobs.unionByName(best_run).where((F.col("tier") != 4) | (micros(now) - micros(F.col("at")) < RECENT_SECONDS * 1_000_000))
    chosen = fresh.orderBy("tier").limit(1).withColumn(
        "seconds", F.when(F.col("tier") == 3, F.lit(0)).otherwise(F.coalesce(seconds, F.lit(0))).cast("bigint"))
    named = chosen.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")
    return named.select("tier", (F.col("tier") < 4).alias("has_active"), "id", "source_id", F.coalesce("source_name", F.lit(labels.ALL_SOURCES)).alias("source_name"),
                        "status", labels.mapped(F.col("timeframe"), labels.TIMEFRAMES).alias("timeframe_label"),
                        labels.mapped(F.col("trigger"), labels.TRIGGERS).alias("trigger_label"), "seconds")
