"""Streaming queries: the given tables replayed as streams, compared with the batch answer."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.catalog.documents import _CANONICAL, _MATCHED, _matched_text, keywords
from opporta.runtime import CHECKPOINT_CONF
from opporta.streaming import counters, ingest, status



def work_folder(spark: SparkSession) -> str:
    """A fresh folder beside the cluster's checkpoints; a private one only in local mode."""
    shared = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if shared:
        return f"{shared.rstrip('/')}/opporta-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def replay(spark: SparkSession, table: DataFrame, folder: str) -> DataFrame:
    """Write the table once as files and read them as a stream."""
    landed = os.path.join(folder, "landed")
    table.write.parquet(landed)
    return spark.readStream.schema(table.schema).parquet(landed)


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run until all input is read; update mode keeps every emitted row."""
    spark, out = stream.sparkSession, os.path.join(folder, "out")
    writer = stream.writeStream.option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        running = writer.outputMode(mode).foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closing(spark, sf) -> DataFrame:
    """One late row that moves the watermark past all others, so that the last windows close."""
    return spark_sql(spark, sf, "SELECT 'closing' AS source, max(CAST(ts AS {TS})) + INTERVAL '30' DAY AS ts, 'NEW' AS outcome FROM {events}")


def outcomes(spark, sf) -> DataFrame:
    return spark_sql(spark, sf, "SELECT source, ts, outcome FROM {v_outcomes}")


@query("stream_outcome_counters", """SELECT source, date_trunc('hour', ts) AS window_start, count(*) AS total_discovered, count(*) FILTER (outcome = 'NEW') AS new_leads,
 count(*) FILTER (outcome = 'DUPLICATE') AS duplicate_leads, count(*) FILTER (outcome LIKE 'FILTERED%') AS filtered_out, count(*) FILTER (outcome = 'ERROR') AS error_count FROM {v_outcomes} GROUP BY ALL""")
def stream_outcome_counters(spark, sf):
    folder = work_folder(spark)
    made = run_to_files(counters.outcome_counters(replay(spark, outcomes(spark, sf).unionByName(closing(spark, sf)), folder)), folder)
    return made.where("source <> 'closing'").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_run_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM {v_outcomes}),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT source, min(ts) AS run_start, max(ts) + INTERVAL '30' MINUTE AS run_end, count(*) AS items, count(*) FILTER (outcome = 'ERROR') AS errors FROM n GROUP BY source, no""")
def stream_run_sessions(spark, sf):
    folder = work_folder(spark)
    made = run_to_files(counters.run_sessions(replay(spark, outcomes(spark, sf).unionByName(closing(spark, sf)), folder)), folder)
    return made.where("source <> 'closing'").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "run_end")})


@query("stream_ingest", "SELECT DISTINCT c AS canonical_url, sha256(c) AS fingerprint FROM (SELECT " + _CANONICAL.replace("{u}", "url") + " AS c FROM {v_url_feed})")
def stream_ingest(spark, sf):
    """The URL feed as a stream: every page is stored once."""
    folder = work_folder(spark)
    feed = spark_sql(spark, sf, "SELECT f.page_id, f.variant, f.url, r.fetched_at FROM {v_url_feed} AS f JOIN {v_raw} AS r ON f.page_id = r.page_id")
    ingest.keep_state_on_disk(spark)
    ingest.start_ingest(replay(spark, feed, folder), f"{folder}/pages", f"{folder}/checkpoint").awaitTermination()
    return ingest.stored_pages(spark, f"{folder}/pages").select("canonical_url", "fingerprint")


@query("stream_keyword_matches", _MATCHED)
def stream_keyword_matches(spark, sf):
    folder = work_folder(spark)
    docs = replay(spark, spark_sql(spark, sf, "SELECT doc_id, '' AS title, text AS raw_content FROM {documents}"), folder)
    sink = ingest.match_batches(lambda: keywords(spark), "doc_id", lambda df, i: _matched_text(df).write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    docs.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


_EVENTS = """SELECT 'src_' || CAST(user_id AS STRING) AS source_id, CASE WHEN user_id % 4 = 0 THEN 'generic' ELSE 'specialized' END AS adapter_mode,
 CASE event_type WHEN 'view' THEN 'SUCCESS' ELSE upper(event_type) END AS status, CASE WHEN event_type = 'error' THEN 'boom' ELSE '' END AS error, ts AS moment FROM {events}"""


@query("stream_source_status", f"""SELECT source_id, CASE WHEN arg_max(error, (moment, status)) <> '' AND max(adapter_mode) = 'generic' THEN 'NEEDS_ADAPTER' ELSE arg_max(status, (moment, status)) END AS status,
 NOT (max(adapter_mode) = 'generic' AND bool_or(error <> '')) AS enabled, max(moment) AS last_at, max(moment) FILTER (status = 'SUCCESS' AND error = '') AS last_success_at FROM ({_EVENTS}) GROUP BY source_id""")
def stream_source_status(spark, sf):
    """Folded state per source; the newest emitted row of a source is its state."""
    ingest.keep_state_on_disk(spark)
    folder = work_folder(spark)
    events = spark_sql(spark, sf, _EVENTS).withColumn("at", F.col("moment").cast("timestamp")).drop("moment")
    made = run_to_files(status.fold_status_stream(replay(spark, events, folder)), folder, "update")
    rest = [c for c in made.columns if c != "source_id"]
    newest = made.groupBy("source_id").agg(F.max_by(F.struct(*rest), "at").alias("r")).select("source_id", "r.*")
    return newest.select("source_id", "status", "enabled", F.col("at").cast("timestamp_ntz").alias("last_at"), F.col("last_success_at").cast("timestamp_ntz").alias("last_success_at"))


@query("stream_stale_workers", "SELECT 'w' || CAST(user_id AS VARCHAR) AS worker_id, max(ts) AS last_seen FROM {events} GROUP BY user_id")
def stream_stale_workers(spark, sf):
    """Workers that went silent; the events arrive in one batch, so each has one last silence."""
    ingest.keep_state_on_disk(spark)
    folder = work_folder(spark)
    beats = spark_sql(spark, sf, "SELECT 'w' || CAST(user_id AS STRING) AS worker_id, ts AS at FROM {events} UNION ALL SELECT 'closing', max(ts) + INTERVAL '1' DAY FROM {events}")
    made = run_to_files(status.stale_workers(replay(spark, beats.withColumn("at", F.col("at").cast("timestamp")), folder)), folder)
    return made.where("worker_id <> 'closing'").select("worker_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))
