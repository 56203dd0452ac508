"""Queries of operators that work on the results of others."""

from __future__ import annotations

from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.operators import documents, feeds, links, match, profiles, repair, resolve
from opporta.plans import search


@query("union_first", """SELECT k, min_by(src, rank) AS src FROM (SELECT l_suppkey AS k, 'line' AS src, 1 AS rank FROM {lineitem} UNION ALL SELECT s_suppkey, 'supplier', 2 FROM {supplier}
 UNION ALL SELECT c_custkey, 'customer', 3 FROM {customer}) GROUP BY k""")
def union_first(spark, sf):
    """Three lists in order of preference, the first row of a key wins."""
    frames = [spark_sql(spark, sf, f"SELECT {key} AS k, '{name}' AS src FROM {{{table}}}") for key, name, table in
              (("l_suppkey", "line", "lineitem"), ("s_suppkey", "supplier", "supplier"), ("c_custkey", "customer", "customer"))]
    return feeds.union_first(frames, "k")


_BYPASS = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'generic' ELSE 'specialized' END AS adapter_mode, o_orderpriority = '2-HIGH' AS is_keyword_feed, o_custkey % 3 = 0 AS hit FROM {orders}"""


@query("keyword_bypass", f"""SELECT o_orderkey, CASE WHEN is_keyword_feed THEN 'erp|ocr' WHEN adapter_mode = 'generic' THEN '' WHEN hit THEN 'camera' ELSE '' END AS keywords,
 CASE WHEN is_keyword_feed THEN '{match.FEED_CATEGORY}' WHEN adapter_mode = 'generic' THEN '{match.CUSTOM_CATEGORY}' WHEN hit THEN 'G' ELSE '' END AS groups, is_keyword_feed OR adapter_mode = 'generic' OR hit AS is_relevant
FROM ({_BYPASS})""")
def keyword_bypass(spark, sf):
    """Custom sites and keyword feeds are relevant without a keyword of their own."""
    none = F.array().cast("array<string>")
    items = spark_sql(spark, sf, _BYPASS).withColumns({
        "matched_keywords": F.when(F.col("hit"), F.array(F.lit("camera"))).otherwise(none), "matched_groups": F.when(F.col("hit"), F.array(F.lit("G"))).otherwise(none),
        "is_relevant": F.col("hit")})
    return match.bypass_keywords(items, ["erp", "ocr"]).select(
        "o_orderkey", F.array_join("matched_keywords", "|").alias("keywords"), F.array_join("matched_groups", "|").alias("groups"), "is_relevant")


_ANSWERS = """SELECT CAST(c_custkey AS STRING) AS doc_url, 'profile' AS kind, CASE c_nationkey % 4 WHEN 0 THEN 'no json ' || c_name WHEN 1 THEN '' WHEN 2 THEN '{"legal_name": "' || c_name || '"}' ELSE '{"legal_name": 5' END AS body FROM {customer}"""


@query("profile_rejects", "SELECT CAST(c_custkey AS VARCHAR) AS doc_url, 'invalid profile' AS reject_reason FROM {customer} WHERE c_nationkey % 4 <> 2")
def profile_rejects(spark, sf):
    return profiles.rejected_profiles(spark_sql(spark, sf, _ANSWERS)).select("doc_url", "reject_reason")


@query("nameless_mentions", "SELECT c_custkey AS mention_id FROM {customer} WHERE c_nationkey % 3 = 0")
def nameless_mentions(spark, sf):
    return resolve.nameless(spark_sql(spark, sf, """SELECT c_custkey AS mention_id, CASE c_nationkey % 3 WHEN 1 THEN 'a.vn' ELSE ' ' END AS domain, CAST(NULL AS STRING) AS tax_code,
 CASE c_nationkey % 3 WHEN 2 THEN c_name END AS legal_name FROM {customer}""")).select("mention_id")


@query("replaced_children", """SELECT l_orderkey AS organization_id, l_linenumber AS child, 'old' AS state FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT o_orderkey, 1, 'new' FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""")
def replaced_children(spark, sf):
    """Children of organizations that were read again are replaced, also by none."""
    stored = spark_sql(spark, sf, "SELECT l_orderkey AS organization_id, l_linenumber AS child, 'old' AS state FROM {lineitem}")
    touched = spark_sql(spark, sf, "SELECT o_orderkey AS organization_id FROM {orders} WHERE o_orderpriority = '1-URGENT'")
    fresh = spark_sql(spark, sf, "SELECT o_orderkey AS organization_id, 1 AS child, 'new' AS state FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
    return resolve.replace_children(stored, fresh, touched)


@query("error_classes", """SELECT event_id, CASE WHEN event_id % 5 IN (1, 3) THEN 'permanent' ELSE 'transient' END AS kind, length(props) < 80 AS short FROM {events}""")
def error_classes(spark, sf):
    """Failed fetches that are not tried again, and probes that show too little text."""
    events = spark_sql(spark, sf, """SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN 'read timed out' WHEN 1 THEN 'HTTP 404 for ' || event_type WHEN 2 THEN 'HTTP 503'
 WHEN 3 THEN 'Connection REFUSED' ELSE 'reset by peer' END AS message FROM {events}""")
    return events.select("event_id", documents.error_class(F.col("message")).alias("kind"), documents.too_short(F.col("props")).alias("short"))


_LINKS = """SELECT 'https://h' || CAST(l_suppkey AS STRING) || '.example.com/a' AS page_url, 'https://h' || CAST(CASE WHEN l_linenumber = 2 THEN l_suppkey + 1 ELSE l_suppkey END AS STRING) || '.example.com/f' || CAST(l_partkey AS STRING)
 || CASE l_returnflag WHEN 'R' THEN '.PDF?x=1' WHEN 'A' THEN '.pdf' ELSE '.html' END AS target_url FROM {lineitem}"""


@query("pdf_links", f"SELECT DISTINCT page_url, target_url FROM ({_LINKS}) WHERE lower(split_part(target_url, '?', 1)) LIKE '%.pdf' AND split_part(page_url, '/', 3) = split_part(target_url, '/', 3)")
def pdf_links(spark, sf):
    return links.pdf_links(spark_sql(spark, sf, _LINKS))


_REPAIR = """SELECT CAST(o_orderkey AS STRING) AS id, 'L' || CAST(o_custkey AS STRING) AS organization_name, CAST(o_orderdate AS {TS}) AS published_at, CAST(NULL AS {TS}) AS updated_at, o_orderstatus FROM {orders}"""


@query("applied_repairs", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'New' ELSE 'L' || o_custkey END AS organization_name,
 CASE o_orderstatus WHEN 'F' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS published_at, CASE o_orderstatus WHEN 'F' THEN TIMESTAMP '2026-08-23' END AS updated_at FROM {orders}""")
def applied_repairs(spark, sf):
    """Only proposals marked as changes are written back."""
    stored = spark_sql(spark, sf, _REPAIR)
    report = stored.select("id", F.when(F.col("o_orderstatus") == "F", "changed").otherwise("same").alias("outcome"), F.lit(None).cast("timestamp_ntz").alias("published_to"), F.lit("New").alias("organization_to"))
    return repair.apply_repair(stored.drop("o_orderstatus"), report, F.lit("2026-08-23").cast("timestamp_ntz"))


@query("lead_evidence", """SELECT CAST(o_orderkey AS VARCHAR) AS lead_id, o_custkey AS organization_id, 's' || s_suppkey AS id FROM {orders} JOIN {supplier} ON s_suppkey = o_custkey""")
def lead_evidence(spark, sf):
    """Evidence rows of the organization of each lead."""
    leads = spark_sql(spark, sf, "SELECT CAST(o_orderkey AS STRING) AS id, o_custkey AS organization_id FROM {orders}")
    return search.lead_children(leads, spark_sql(spark, sf, "SELECT s_suppkey AS organization_id, 's' || CAST(s_suppkey AS STRING) AS id FROM {supplier}"))
