"""Queries over keyword and source registries, and over restored organization tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.catalog.documents import at
from opporta.operators import registry
from opporta.sources import tables

_DISCOVERY = "SELECT p_partkey AS position, upper(p_name) || '  x' AS keyword FROM {part}"
_GROUPS = """SELECT p_partkey AS position, p_brand AS group_id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'Group ' || p_brand END AS group_name, ' ' || p_name || CASE WHEN p_size > 25 THEN ' x' ELSE ' y' END AS keyword FROM {part}"""


@query("keyword_registry", r"""
WITH rows AS (SELECT 0 AS part, position, trim(regexp_replace(keyword, '\s+', ' ', 'g')) AS keyword, NULL AS group_id, NULL AS group_name FROM (""" + _DISCOVERY + r""")
 UNION ALL SELECT 1, position, trim(regexp_replace(keyword, '\s+', ' ', 'g')), group_id, coalesce(nullif(group_name, ''), group_id) FROM (""" + _GROUPS + r"""))
SELECT arg_min(keyword, (part, position)) AS keyword, coalesce(arg_max(group_id, position) FILTER (part = 1), 'custom') AS group_id,
 coalesce(arg_max(group_name, position) FILTER (part = 1), 'Từ khóa tùy chỉnh') AS group_name, bool_or(part = 1) AS use_for_filter, bool_or(part = 0) AS use_for_discovery FROM rows GROUP BY lower(keyword)""")
def keyword_registry(spark, sf):
    seeded = registry.seed_keywords(spark_sql(spark, sf, _DISCOVERY), spark_sql(spark, sf, _GROUPS))
    return seeded.select("keyword", "group_id", "group_name", "use_for_filter", "use_for_discovery")


_STORED = """SELECT p_partkey AS position, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_brand AS keyword, p_type AS group_id, '' AS group_name,
 CASE p_size % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'Có' WHEN 2 THEN '' ELSE 'TRUE' END AS use_for_filter, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '0' END AS use_for_discovery,
 CASE WHEN p_partkey % 5 = 0 THEN 'false' ELSE '' END AS active FROM {part}"""


@query("keyword_cleanup", f"""SELECT keyword, group_id, 'Từ khóa tùy chỉnh' AS group_name, use_for_filter <> 'no' AS use_for_filter, use_for_discovery = 'x' AS use_for_discovery FROM (
 SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY position) AS rn FROM ({_STORED}) WHERE active = '') WHERE rn = 1""")
def keyword_cleanup(spark, sf):
    return registry.clean_keywords(spark_sql(spark, sf, _STORED)).select("keyword", "group_id", "group_name", "use_for_filter", "use_for_discovery")


_PARTS = r"""list_filter(list_transform(string_split_regex(text, '[,;\r\n]+'), lambda k: trim(regexp_replace(k, '\s+', ' ', 'g'))), lambda k: k <> '')"""


@query("keyword_import", f"""
WITH p AS (SELECT doc_id, {_PARTS} AS parts FROM {{documents}}),
 q AS (SELECT *, list_transform(parts, lambda k: replace(lower(k), 'ß', 'ss')) AS keys, len(list_filter(parts, lambda k: length(k) > 160)) > 0 AS long FROM p),
 r AS (SELECT *, CASE WHEN len(parts) = 0 THEN 'empty' WHEN long THEN 'keyword too long' WHEN len(list_distinct(keys)) > 1000 THEN 'too many keywords' END AS error FROM q)
SELECT doc_id, error, CASE WHEN error IS NULL THEN array_to_string(list_filter(parts, lambda k, i: list_position(keys, keys[i]) = i), '|') ELSE '' END AS keywords FROM r""")
def keyword_import(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text AS content FROM {documents}", spread="documents")
    return registry.import_keywords(docs, "doc_id").select("doc_id", "error", F.array_join("keywords", "|").alias("keywords"))


_OLD = "SELECT p_partkey AS position, p_name || ' ' || CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS keyword, p_brand AS group_id, p_brand AS group_name, TRUE AS use_for_filter, p_size > 25 AS use_for_discovery FROM {part}"
_NEW = "SELECT l_orderkey * 10 + l_linenumber AS position, upper(p_name) || ' ' || CASE WHEN l_returnflag = 'R' THEN p_type ELSE p_brand END AS keyword, 'custom' AS group_id, 'c' AS group_name, TRUE AS use_for_filter, l_quantity > 49 AS use_for_discovery FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
_UPSERT = f"""WITH o AS (SELECT lower(keyword) AS key, arg_min(use_for_discovery, position) AS d FROM ({_OLD}) GROUP BY 1),
 n AS (SELECT lower(keyword) AS key, count(*) AS rows, bool_or(use_for_discovery) AS wants FROM ({_NEW}) GROUP BY 1),
 m AS (SELECT key, CASE WHEN rows IS NULL THEN 'kept' WHEN d IS NULL THEN 'added' WHEN wants AND NOT d THEN 'promoted' ELSE 'duplicate' END AS action, coalesce(rows, 0) AS rows FROM o FULL JOIN n USING (key))"""


def upserted(spark, sf):
    return registry.upsert_keywords(spark_sql(spark, sf, _OLD), spark_sql(spark, sf, _NEW))


@query("keyword_upsert", _UPSERT + " SELECT key, action, rows - CASE WHEN action IN ('added', 'promoted') THEN 1 ELSE 0 END AS duplicates FROM m")
def keyword_upsert(spark, sf):
    return upserted(spark, sf).select("key", "action", "duplicates")


@query("keyword_upsert_totals", _UPSERT + """ SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'promoted') AS promoted,
 CAST(sum(rows - CASE WHEN action IN ('added', 'promoted') THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM m""")
def keyword_upsert_totals(spark, sf):
    return registry.upsert_totals(upserted(spark, sf))


@query("discovery_budget", f"""SELECT count(DISTINCT key) AS keywords, count(DISTINCT key) <= 20 AS within_limit FROM (SELECT lower(keyword) AS key FROM ({_OLD}) WHERE use_for_discovery UNION ALL SELECT lower(keyword) FROM ({_NEW}))""")
def discovery_budget(spark, sf):
    return registry.discovery_budget(spark_sql(spark, sf, _OLD), spark_sql(spark, sf, _NEW).select("keyword"))


@query("registry_counts", f"SELECT count(*) AS total, count(*) FILTER (use_for_filter) AS filter_total, count(*) FILTER (use_for_discovery) AS discovery_total FROM ({_OLD})")
def registry_counts(spark, sf):
    return registry.registry_counts(spark_sql(spark, sf, _OLD))


_CELLS = """SELECT c_custkey AS position, ' s' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS id, '' AS name,
 CASE c_custkey % 5 WHEN 0 THEN '["Site' || CAST(c_custkey AS STRING) || '.VN","", "http://e.vn:8080/a/?q=1#f"]' WHEN 1 THEN '[]' WHEN 2 THEN 'plain' || CAST(c_custkey AS STRING) || '.vn/x/'
  WHEN 3 THEN '' ELSE '{broken' END AS seed_urls, '' AS adapter_mode, c_mktsegment AS adapter_key, '' AS status, CASE WHEN c_nationkey > 10 THEN '2.5' ELSE '0' END AS rate_limit_delay,
 CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS enabled, '' AS include_in_schedule FROM {customer}"""


@query("source_registry", f"""SELECT trim(id) AS id, trim(id) AS name, CASE position % 5 WHEN 0 THEN 'https://site' || position || '.vn/|http://e.vn:8080/a?q=1' WHEN 2 THEN 'https://plain' || position || '.vn/x' ELSE 'https://{{broken/' END AS seed_urls,
 'generic' AS adapter_mode, CASE WHEN rate_limit_delay = '2.5' THEN 2.5 ELSE 1.0 END AS rate_limit_delay, enabled = 'yes' AS enabled, FALSE AS include_in_schedule
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS rn FROM ({_CELLS}) WHERE position % 5 IN (0, 2, 4)) WHERE rn = 1""")
def source_registry(spark, sf):
    clean = registry.clean_sources(spark_sql(spark, sf, _CELLS))
    return clean.select("id", "name", F.array_join("seed_urls", "|").alias("seed_urls"), "adapter_mode", "rate_limit_delay", "enabled", "include_in_schedule")


_REQUESTED = """SELECT o_orderkey AS position, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN ' ' ELSE 'Site  ' || CAST(o_custkey AS STRING) END AS name,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'http://192.168.0.' || CAST(o_custkey % 256 AS STRING) ELSE 'HTTPS://Www.Site' || CAST(o_custkey AS STRING) || '.vn/' END AS url FROM {orders}"""


@query("custom_sources", f"""
WITH r AS (SELECT position, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, CASE WHEN url LIKE 'http:%' THEN url || '/' ELSE lower(url) END AS url, trim(name) = '' AS bad, url LIKE 'http:%' AS closed FROM ({_REQUESTED})),
 f AS (SELECT url, min(position) AS first FROM r WHERE NOT bad GROUP BY url)
SELECT position, CASE WHEN bad THEN 'error' WHEN url IN (SELECT 'https://www.site' || CAST(l_suppkey AS VARCHAR) || '.vn/' FROM {{lineitem}}) OR position > first THEN 'duplicate' ELSE 'added' END AS action,
 'custom-' || left(regexp_replace(regexp_extract(url, '://([^/]*)', 1), '[^a-z0-9]+', '-', 'g'), 32) || '-' || left(sha256(url), 8) AS id, NOT closed AS enabled FROM r LEFT JOIN f USING (url)""")
def custom_sources(spark, sf):
    stored = spark_sql(spark, sf, "SELECT array('https://WWW.site' || CAST(l_suppkey AS STRING) || '.vn/') AS seed_urls FROM {lineitem}")
    return registry.custom_sources(spark_sql(spark, sf, _REQUESTED, spread="orders"), stored).select("position", "action", "id", "enabled")


@query("source_merge", """SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(nullif(n.name, ''), o.name) AS name, coalesce(n.enabled, o.enabled) AS enabled
FROM {v_sources} o FULL JOIN (SELECT 'src_' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS name, c_nationkey > 12 AS enabled FROM {customer}) n ON n.id = o.id""")
def source_merge(spark, sf):
    new = spark_sql(spark, sf, "SELECT 'src_' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS name, c_nationkey > 12 AS enabled FROM {customer}")
    return registry.merge_sources(spark_sql(spark, sf, "SELECT * FROM {v_sources}"), new, ["name"], ["enabled"])


def organizations(spark, sf):
    """Suppliers as organizations; one project and one news item each."""
    s = spark_sql(spark, sf, "SELECT * FROM {supplier}")
    empty = F.array().cast("array<struct<title:string,source_url:string>>")
    link = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".vn"))
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("legal_name"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.array(F.struct(F.lit("P").alias("name"), F.col("s_name").alias("summary"), link.alias("source_url")),
                F.struct(F.lit("P").alias("name"), F.lit("again").alias("summary"), link.alias("source_url"))).alias("projects"),
        F.array(F.struct(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("title"), F.lit("2026-01-01").alias("published_at"), link.alias("source_url"))).alias("news"),
        empty.alias("jobs"), empty.alias("tenders"))


@query("collection_rows", """
SELECT left(sha256(s_suppkey || '|projects|https://s' || s_suppkey || '.vn|P'), 36) AS id, CAST(s_suppkey AS VARCHAR) AS organization_id, 'projects' AS kind, 'P' AS title, 'again' AS summary, NULL AS published_at,
 '{"name":"P","summary":"again","source_url":"https://s' || s_suppkey || '.vn"}' AS payload FROM {supplier}
UNION ALL SELECT left(sha256(s_suppkey || '|news|https://s' || s_suppkey || '.vn|N' || s_nationkey), 36), CAST(s_suppkey AS VARCHAR), 'news', 'N' || s_nationkey, NULL, '2026-01-01',
 '{"title":"N' || s_nationkey || '","published_at":"2026-01-01","source_url":"https://s' || s_suppkey || '.vn"}' FROM {supplier}""")
def collection_rows(spark, sf):
    return tables.collection_rows(organizations(spark, sf)).select("id", "organization_id", "kind", "title", "summary", "published_at", "payload")


@query("profile_restore", """SELECT c.organization_id, c.full_name, CASE WHEN c.phone <> '' AND regexp_matches(c.phone, '^0[35789]') THEN c.phone END AS phone, c.decision_score, TIMESTAMP '2026-01-02 03:04:05' AS verified_at
FROM {v_contacts} c WHERE c.organization_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM {supplier} WHERE s_acctbal > 1000)""")
def profile_restore(spark, sf):
    """Contact cells whose organization cell row is usable."""
    orgs = tables.restore_organizations(spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN s_acctbal > 1000 THEN s_name ELSE ' ' END AS legal_name, '[\"a\"]' AS aliases, 'x' AS locations FROM {supplier}"))
    cells = spark_sql(spark, sf, """SELECT CAST(position AS STRING) AS id, organization_id || ' ' AS organization_id, full_name, '' AS raw_title, '' AS role_group, email, phone, '' AS profile_url, '' AS source_url,
 '' AS evidence_text, CAST(CAST(decision_score AS DOUBLE) AS STRING) AS decision_score, '' AS decision_reason, '2026-01-02T03:04:05Z' AS verified_at FROM {v_contacts}""")
    return tables.restore_contacts(cells, orgs).select("organization_id", "full_name", "phone", "decision_score", "verified_at")


@query("evidence_restore", """SELECT CAST(l_suppkey AS VARCHAR) AS organization_id, l_returnflag AS field, CASE WHEN l_linenumber > 3 THEN 0.0 ELSE l_discount END AS confidence, TIMESTAMP '2026-01-01 00:00:00' AS crawled_at
FROM {lineitem} WHERE l_suppkey IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 1000)""")
def evidence_restore(spark, sf):
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id FROM {supplier} WHERE s_acctbal > 1000")
    cells = spark_sql(spark, sf, """SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_suppkey AS STRING) AS organization_id, l_returnflag AS field, 'v' AS value, 'https://x' AS source_url, CAST(NULL AS STRING) AS evidence_text,
 'bad date' AS crawled_at, CASE WHEN l_linenumber > 3 THEN 'n/a' ELSE CAST(l_discount AS STRING) END AS confidence FROM {lineitem}""")
    return tables.restore_evidence(cells, orgs, at("2026-01-01 00:00:00")).select("organization_id", "field", "confidence", "crawled_at")


@query("collection_restore", """SELECT CAST(l_suppkey AS VARCHAR) AS organization_id, CASE WHEN l_linenumber > 3 THEN 'news' ELSE 'projects' END AS kind,
 CASE WHEN l_returnflag = 'R' THEN '{"name":"' || l_partkey || '"}' ELSE '{"title":"T","summary":null,"published_at":null,"source_url":"https://x"}' END AS payload
FROM {lineitem} WHERE l_suppkey IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 1000)""")
def collection_restore(spark, sf):
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id FROM {supplier} WHERE s_acctbal > 1000")
    cells = spark_sql(spark, sf, """SELECT CAST(l_suppkey AS STRING) || ' ' AS organization_id, CASE WHEN l_linenumber > 3 THEN 'news' ELSE 'projects' END AS kind, l_orderkey AS position,
 CASE l_returnflag WHEN 'R' THEN '{"name":"' || CAST(l_partkey AS STRING) || '"}' WHEN 'A' THEN '{}' ELSE '{broken' END AS payload, 'T' AS title, CAST(NULL AS STRING) AS summary,
 CAST(NULL AS STRING) AS published_at, 'https://x' AS source_url FROM {lineitem}""")
    return tables.restored_payloads(cells, orgs).select("organization_id", "kind", "payload")
