"""Queries over runs, jobs and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.catalog.documents import at
from opporta.catalog.leads import leads
from opporta.operators import registry, repair, triage
from opporta.plans import operations

NOW = "2001-08-01 02:05:00"
FINISHED_NOW = "2001-07-31 02:05:00"


def runs(spark, sf):
    return spark_sql(spark, sf, "SELECT * FROM {v_runs}")


def jobs(spark, sf):
    return spark_sql(spark, sf, "SELECT * FROM {v_jobs}")


def sources(spark, sf):
    return spark_sql(spark, sf, "SELECT * FROM {v_sources}")


@query("latest_run", """SELECT source, id, status, start_time, total_discovered FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_time DESC, id DESC) AS rn FROM {v_runs}) WHERE rn = 1""")
def latest_run(spark, sf):
    return operations.latest_runs(runs(spark, sf)).select("source", "id", "status", "start_time", "total_discovered")


_JOB = """SELECT source_id, arg_min(status, (requested_at, id, status)) AS status, min((requested_at, id, status)) AS j FROM {v_jobs} WHERE status IN ('QUEUED', 'RUNNING') GROUP BY source_id"""


@query("source_overview", f"""
WITH counts AS (SELECT source, count(*) AS total_leads, count(*) FILTER (recommended_action = 'CALL') AS hot_leads FROM {{v_leads}} GROUP BY source),
 last AS (SELECT source, arg_max(status, (start_time, id)) AS run_status, max(start_time) AS last_crawl_at FROM {{v_runs}} GROUP BY source),
 own AS (SELECT * FROM ({_JOB}) WHERE source_id IS NOT NULL), shared AS (SELECT j, status FROM ({_JOB}) WHERE source_id IS NULL)
SELECT s.id, s.name, s.enabled, coalesce(total_leads, 0) AS total_leads, coalesce(hot_leads, 0) AS hot_leads, last_crawl_at,
 coalesce(CASE WHEN own.j IS NULL OR shared.j < own.j THEN shared.status ELSE own.status END, run_status, s.status) AS runtime_status,
 CASE WHEN adapter_mode = 'specialized' THEN 'P0' ELSE 'CUSTOM' END AS priority
FROM {{v_sources}} s LEFT JOIN counts ON counts.source = s.id LEFT JOIN last ON last.source = s.id LEFT JOIN own ON own.source_id = s.id LEFT JOIN shared ON TRUE""")
def source_overview(spark, sf):
    return operations.source_overview(sources(spark, sf), leads(spark, sf), runs(spark, sf), jobs(spark, sf))


_TF = "CASE timeframe WHEN '1_day' THEN '24 giờ qua' WHEN '1_week' THEN '7 ngày qua' WHEN '1_month' THEN '30 ngày qua' ELSE timeframe END"
_TR = "CASE trigger WHEN 'FE' THEN 'Thủ công từ giao diện' WHEN 'SCHEDULE' THEN 'Tự động theo lịch' WHEN 'CLI' THEN 'Dòng lệnh' ELSE trigger END"


@query("job_labels", f"""SELECT j.id, coalesce(s.name, 'Tất cả các nguồn dữ liệu') AS source_name, {_TF} AS timeframe_label, {_TR} AS trigger_label, requested_at + INTERVAL '7' HOUR AS requested_local
FROM {{v_jobs}} j LEFT JOIN {{v_sources}} s ON s.id = j.source_id""")
def job_labels(spark, sf):
    return operations.with_job_labels(jobs(spark, sf), sources(spark, sf)).select("id", "source_name", "timeframe_label", "trigger_label", "requested_local")


@query("queue_view", f"""SELECT j.id, CAST(row_number() OVER (ORDER BY requested_at, j.id) AS INT) AS place, j.status, coalesce(s.name, 'Tất cả các nguồn dữ liệu') AS source_name, {_TF} AS timeframe_label
FROM (SELECT * FROM {{v_jobs}} WHERE status IN ('QUEUED', 'PAUSED') ORDER BY requested_at, id LIMIT 20) j LEFT JOIN {{v_sources}} s ON s.id = j.source_id""")
def queue_view(spark, sf):
    return operations.queue_view(jobs(spark, sf), sources(spark, sf)).select("id", "place", "status", "source_name", "timeframe_label")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("QUEUED", "RUNNING", "PAUSED", "SUCCESS", "PARTIAL", "FAILED", "INTERRUPTED"))


@query("queue_counts", f"SELECT count(*) FILTER (status IN ('QUEUED', 'PAUSED')) AS queue_depth, {_COUNTS} FROM {{v_jobs}}")
def queue_counts(spark, sf):
    return operations.queue_counts(jobs(spark, sf))


@query("recent_jobs", """SELECT id, status, requested_at, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN result_json END AS result_json FROM {v_jobs} ORDER BY requested_at DESC, id LIMIT 20""")
def recent_jobs(spark, sf):
    return operations.recent_jobs(jobs(spark, sf)).select("id", "status", "requested_at", "result_json")


def _activity(tiers: str, now: str = NOW) -> str:
    return f"""
WITH c AS (SELECT CASE WHEN status IN ('RUNNING', 'PAUSED') THEN 1 WHEN status = 'QUEUED' THEN 3 ELSE 4 END AS tier, * FROM {{v_jobs}} WHERE {tiers}),
 best AS (SELECT tier, id, source_id, status, trigger, timeframe, CASE tier WHEN 1 THEN started_at WHEN 3 THEN requested_at ELSE completed_at END AS happened FROM c),
 pick AS (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 3 THEN epoch_us(happened) ELSE -epoch_us(happened) END, id) AS rn FROM best
   WHERE tier <> 4 OR happened > TIMESTAMP '{now}' - INTERVAL '600' SECOND)
SELECT tier, tier < 4 AS has_active, p.id, p.source_id, coalesce(s.name, 'Tất cả các nguồn dữ liệu') AS source_name, p.status, {_TF} AS timeframe_label, {_TR} AS trigger_label,
 CASE WHEN tier = 3 THEN 0 ELSE greatest(0, CAST(floor((epoch_us(TIMESTAMP '{now}') - epoch_us(happened)) / 1000000) AS BIGINT)) END AS seconds
FROM pick p LEFT JOIN {{v_sources}} s ON s.id = p.source_id WHERE rn = 1"""


@query("current_activity", _activity("TRUE"))
def current_activity(spark, sf):
    return operations.current_activity(jobs(spark, sf), runs(spark, sf), sources(spark, sf), at(NOW))


@query("current_activity_queued", _activity("status <> 'RUNNING' AND status <> 'PAUSED'"))
def current_activity_queued(spark, sf):
    idle = runs(spark, sf).withColumn("status", F.lit("SUCCESS"))
    return operations.current_activity(jobs(spark, sf).where("status NOT IN ('RUNNING', 'PAUSED')"), idle, sources(spark, sf), at(NOW))


@query("current_activity_finished", _activity("status IN ('SUCCESS', 'PARTIAL', 'FAILED', 'INTERRUPTED')", FINISHED_NOW))
def current_activity_finished(spark, sf):
    idle = runs(spark, sf).withColumn("status", F.lit("SUCCESS"))
    return operations.current_activity(jobs(spark, sf).where("status IN ('SUCCESS', 'PARTIAL', 'FAILED', 'INTERRUPTED')"), idle, sources(spark, sf), at(FINISHED_NOW))


@query("job_rollup", """SELECT job_id, CASE WHEN bool_and(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status IN ('FAILED', 'PARTIAL')) THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, count(*) AS sources,
 CAST(sum(total_discovered) AS BIGINT) AS total_discovered, CAST(sum(new_leads) AS BIGINT) AS new_leads, CAST(sum(duplicate_leads) AS BIGINT) AS duplicate_leads,
 CAST(sum(filtered_out) AS BIGINT) AS filtered_out, CAST(sum(error_count) AS BIGINT) AS error_count FROM {v_runs} GROUP BY job_id""")
def job_rollup(spark, sf):
    return triage.job_rollup(runs(spark, sf))


@query("run_status", """SELECT id, CASE WHEN status = 'FAILED' THEN 'FAILED' WHEN source IN ('src_1', 'src_5') THEN 'PARTIAL' WHEN error_count = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM {v_runs}""")
def run_status(spark, sf):
    stopped = F.col("source").isin("src_1", "src_5")
    return runs(spark, sf).select("id", triage.run_status(F.col("error_count"), F.col("status") == "FAILED", stopped).alias("status"))


@query("run_recovery", """SELECT id, CASE WHEN status = 'RUNNING' THEN 'INTERRUPTED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE end_time END AS end_time FROM {v_runs}""")
def run_recovery(spark, sf):
    return repair.recover_runs(runs(spark, sf), at("2024-02-01 00:00:00"), at("2024-01-31 23:59:30")).select("id", "status", "end_time")


@query("job_requeue", """SELECT id, CASE WHEN status = 'RUNNING' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status <> 'RUNNING' THEN started_at END AS started_at, CASE WHEN status <> 'RUNNING' THEN worker_id END AS worker_id FROM {v_jobs}""")
def job_requeue(spark, sf):
    return repair.requeue_jobs(jobs(spark, sf)).select("id", "status", "started_at", "worker_id")


@query("interrupted_sources", "SELECT DISTINCT source AS id FROM {v_runs} WHERE status = 'RUNNING' UNION SELECT id FROM {v_sources} WHERE status = 'RUNNING'")
def interrupted_sources(spark, sf):
    return repair.interrupted_sources(runs(spark, sf), sources(spark, sf))


@query("scheduled_sources", """SELECT id, CASE WHEN adapter_mode = 'generic' THEN 'generic' WHEN adapter_key IN ('chinhphu', 'vnexpress', 'topcv') THEN adapter_key END AS rule FROM {v_sources} WHERE enabled AND include_in_schedule""")
def scheduled_sources(spark, sf):
    return registry.runnable_sources(sources(spark, sf), scheduled_only=True).select("id", "rule")


@query("source_status_fold", """
WITH ev AS (SELECT 'src_' || CAST(user_id AS VARCHAR) AS id, upper(event_type) AS status, CASE WHEN event_type = 'error' THEN 'boom' END AS error, ts FROM {events}),
 f AS (SELECT id, arg_max(status, (ts, status)) AS status, arg_max(error IS NOT NULL, (ts, status)) AS failed, max(ts) AS at, bool_or(error IS NOT NULL) AS ever, max(ts) FILTER (error IS NULL AND status = 'SUCCESS') AS ok FROM ev GROUP BY id)
SELECT s.id, CASE WHEN adapter_mode = 'generic' AND f.failed THEN 'NEEDS_ADAPTER' ELSE coalesce(f.status, s.status) END AS status,
 CASE WHEN f.failed THEN 'Nguồn này chưa crawl được, cần cập nhật adapter sau.' ELSE '' END AS last_error, s.enabled AND NOT (adapter_mode = 'generic' AND coalesce(f.ever, FALSE)) AS enabled, f.at AS last_attempt_at
FROM {v_sources} s LEFT JOIN f USING (id)""")
def source_status_fold(spark, sf):
    events = spark_sql(spark, sf, """SELECT 'src_' || CAST(user_id AS STRING) AS source_id, upper(event_type) AS status, CASE WHEN event_type = 'error' THEN 'boom' END AS error, CAST(ts AS {TS}) AS at FROM {events}""")
    base = sources(spark, sf).withColumns({"last_attempt_at": F.lit(None).cast("timestamp_ntz"), "last_success_at": F.lit(None).cast("timestamp_ntz")})
    return registry.fold_status(base, events).select("id", "status", "last_error", "enabled", "last_attempt_at")
