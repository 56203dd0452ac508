"""Queries over stored tables that a job reads and changes: upsert, ingest, bucketed keys, resolution of new mentions, deep pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.catalog.documents import _CANONICAL, raw
from opporta.catalog.leads import _LABELS, leads
from opporta.catalog.streams import replay, work_folder
from opporta.operators import dedup, resolve
from opporta.plans import search
from opporta.sources import lead_table
from opporta.streaming import ingest

BUCKETS = 16


@query("lead_upsert_published", """SELECT id, title, score, status, source_url FROM {v_leads} WHERE position % 23 <> 5
UNION ALL SELECT id, title, CAST(score + 1 AS INT), 'CONTACTED', source_url FROM {v_leads} WHERE position % 23 = 5
UNION ALL SELECT 'n' || id, title, score, status, NULL FROM {v_leads} WHERE position % 31 = 7""")
def lead_upsert_published(spark, sf):
    """Changed and new leads go into the stored table, which is then read again."""
    folder = work_folder(spark)
    base = leads(spark, sf).select("id", "title", "score", "status", "source_url", "position")
    lead_table.create(base.drop("position"), f"{folder}/leads", "id", BUCKETS)
    changed = base.where("position % 23 = 5").select("id", "title", (F.col("score") + 1).alias("score"), F.lit("CONTACTED").alias("status"), "source_url")
    new = base.where("position % 31 = 7").select(F.concat(F.lit("n"), "id").alias("id"), "title", "score", "status")
    lead_table.publish(changed.unionByName(new, allowMissingColumns=True), f"{folder}/leads", "id", f"{folder}/step", BUCKETS)
    return lead_table.read(spark, f"{folder}/leads").drop(lead_table.BUCKET)


@query("stream_lead_upsert", """SELECT sha256(source_url) AS content_fingerprint, source_url, CASE WHEN position % 3 = 0 THEN 'CONTACTED' ELSE status END AS status, score,
 crawled_at + CASE WHEN position % 3 = 0 THEN INTERVAL '0' DAY ELSE INTERVAL '1' DAY END AS crawled_at FROM {v_leads}""")
def stream_lead_upsert(spark, sf):
    """Assembled leads arrive twice as a stream; a third of them is stored already and was worked on."""
    folder = work_folder(spark)
    found = dedup.with_fingerprint(leads(spark, sf), "source_url").select(
        F.col("fingerprint").alias("content_fingerprint"), F.col("canonical_url").alias("source_url"), "status", "score", "crawled_at", "position")
    lead_table.create(found.where("position % 3 = 0").withColumn("status", F.lit("CONTACTED")).drop("position"), f"{folder}/leads", "content_fingerprint", BUCKETS)
    later = found.drop("position").withColumn("crawled_at", F.col("crawled_at") + F.expr("INTERVAL '1' DAY"))
    arriving = replay(spark, later.unionByName(later), folder)
    ingest.keep_state_on_disk(spark)
    ingest.start_lead_ingest(arriving, f"{folder}/leads", f"{folder}/checkpoint", ["crawled_at"], delay="30 days", buckets=BUCKETS).awaitTermination()
    return lead_table.read(spark, f"{folder}/leads").drop(lead_table.BUCKET)


@query("new_documents_bucketed", "SELECT c AS canonical_url, min(page_id) AS page_id FROM (SELECT " + _CANONICAL.replace("{u}", "url") + """ AS c, page_id FROM {v_url_feed})
 WHERE c NOT IN (SELECT """ + _CANONICAL.replace("{u}", "url") + " FROM {v_raw} WHERE status_code < 400 AND content_type IS NOT NULL) GROUP BY c")
def new_documents_bucketed(spark, sf):
    """The first arrival of every page that the bucketed table of stored pages lacks."""
    known = dedup.with_fingerprint(raw(spark, sf).where("status_code < 400 AND content_type IS NOT NULL").select("url"))
    table = f"stored_pages_{uuid.uuid4().hex}"
    dedup.store_fingerprints(known, table, f"{work_folder(spark)}/pages", BUCKETS)
    feed = dedup.with_fingerprint(spark_sql(spark, sf, "SELECT page_id, variant, url FROM {v_url_feed}"))
    return dedup.not_stored(feed, table, ["page_id", "variant"]).select("canonical_url", "page_id")


def _delta(spark, sf):
    """All mentions but every seventh resolved before, those then against the stored result."""
    mentions = spark_sql(spark, sf, "SELECT *, CAST(substr(mention_id, 2) AS BIGINT) % 7 = 0 AS late FROM {v_mentions}")
    before = mentions.where("NOT late").drop("late")
    labels, names = resolve.resolution_state(before)
    return resolve.resolve(before), labels, names, resolve.resolve_delta(labels, names, mentions.where("late").drop("late"))


@query("org_resolution_delta", _LABELS + " SELECT mention_id, component FROM resolved")
def org_resolution_delta(spark, sf):
    """Stored and new mentions together are as a full run has them."""
    stored, _, _, delta = _delta(spark, sf)
    return resolve.relabelled(stored, delta).select("mention_id", "component").unionByName(delta.resolved.select("mention_id", "component"))


@query("org_state_delta", _LABELS + " SELECT node, component FROM parts")
def org_state_delta(spark, sf):
    """The labels to store after the delta are those of a full run."""
    _, labels, names, delta = _delta(spark, sf)
    return resolve.relabelled_state(labels, names, delta)[0]


_ORDER = "ORDER BY score DESC NULLS LAST, crawled_at DESC NULLS LAST, id"


@query("search_leads_deep_page", f"""SELECT id, score, crawled_at FROM {{v_leads}} WHERE status <> 'ARCHIVED' {_ORDER} LIMIT 20 OFFSET 1000""")
def search_leads_deep_page(spark, sf):
    """Page 51, sought by the row before it."""
    return search.seek_page(search.filter_leads(leads(spark, sf)), 51).select("id", "score", "crawled_at")


@query("search_page_ends", f"""SELECT CAST(n // 20 AS BIGINT) AS page, score, crawled_at, id FROM (SELECT *, row_number() OVER ({_ORDER}) AS n FROM {{v_leads}} WHERE status <> 'ARCHIVED') WHERE n % 20 = 0""")
def search_page_ends(spark, sf):
    """Where every page of all shown leads ends."""
    return search.page_ends(search.filter_leads(leads(spark, sf)))
