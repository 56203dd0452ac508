"""Queries of files written and read back, request and answer forms, child rows, and links of keyword searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.catalog.documents import at, raw
from opporta.catalog.leads import NOW, leads
from opporta.catalog.streams import work_folder
from opporta.operators import documents, leads as ops, links, ordering, profiles, requests, resolve, responses
from opporta.plans import search
from opporta.schemas import CONTACTS, EVIDENCE, LEAD_SHEET
from opporta.sources import tables

_DAY = "20260105"


@query("snapshot_files", f"""SELECT source_id, left(sha256(url), 16) AS snapshot_hash, CAST(fetched_at AS DATE) AS day, sha256(html) AS html_sha256, length(html) AS n_chars
FROM {{v_raw}} WHERE strftime(fetched_at, '%Y%m%d') = '{_DAY}'""")
def snapshot_files(spark, sf):
    """Pages written by day and source; one day is read back."""
    folder = f"{work_folder(spark)}/snapshots"
    documents.write_snapshots(raw(spark, sf), folder)
    return documents.read_snapshots(spark, folder, day=_DAY).select(
        "source_id", "snapshot_hash", "day", F.sha2("html", 256).alias("html_sha256"), F.length("html").alias("n_chars"))


_TITLE = "'Tin \"' || id || '\", dòng 1;' || chr(10) || ' dòng 2, ' || title"


def _sheet_leads(spark, sf):
    none = F.lit(None).cast("string")
    full = leads(spark, sf, spread="orders").withColumns({c: none for c in ("sales_strategy", "content_fingerprint", "sales_notes", "enrichment_status", "enrichment_message")})
    return full.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).withColumn("title", F.expr(_TITLE))


@query("lead_sheet_files", f"""SELECT id, source_url, {_TITLE} AS title, published_at, deadline, replace(categories, '|', '+') AS need_categories, budget_value, score, status
FROM {{v_leads}} WHERE status <> 'PENDING_AI' AND NOT starts_with(lower(need_summary), '[hàng đợi ai]') AND score >= 40""")
def lead_sheet_files(spark, sf):
    """Leads with quotes and line ends in their cells, through CSV files and back."""
    folder = f"{work_folder(spark)}/sheet"
    tables.write_sheet(tables.lead_sheet_rows(_sheet_leads(spark, sf)), folder)
    back = tables.read_sheet(spark, folder, LEAD_SHEET).withColumn("position", F.col("id").cast("bigint"))
    rows = tables.leads_from_sheet(back, back.select("source_url").limit(0), at(NOW))
    return rows.select("id", "source_url", "title", "published_at", "deadline", F.array_join("need_categories", "+").alias("need_categories"), "budget_value", "score", "status")


@query("lead_json_files", f"""SELECT id, {_TITLE} AS title, score, replace(categories, '|', '+') AS need_categories, budget_value, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, status FROM {{v_leads}}""")
def lead_json_files(spark, sf):
    folder = f"{work_folder(spark)}/json"
    full = _sheet_leads(spark, sf)
    tables.write_json(full.withColumn("need_summary", F.col("title")), folder)
    back = spark.read.json(folder, schema="id string, score int, need_summary string, need_categories array<string>, budget_value double, published_at string, status string")
    return back.select("id", F.col("need_summary").alias("title"), "score", F.array_join("need_categories", "+").alias("need_categories"), "budget_value", "published_at", "status")


_ORGS = """SELECT CAST(s_suppkey AS STRING) AS id, s_name || ', "' || CAST(s_nationkey AS STRING) || '"' AS legal_name, 'd' || CAST(s_suppkey AS STRING) || '.vn' AS domain, s_acctbal AS verification_confidence,
 s_nationkey % 2 = 0 AS search_used, CAST(DATE '2026-01-01' + CAST(s_nationkey AS INT) AS {TS}) AS verified_at FROM {supplier}"""


@query("organization_sheet_files", """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ', "' || s_nationkey || '"' AS legal_name, 'd' || s_suppkey || '.vn' AS domain, s_acctbal AS verification_confidence,
 s_nationkey % 2 = 0 AS search_used, DATE '2026-01-01' + CAST(s_nationkey AS INT) + INTERVAL '0' HOUR AS verified_at, 'A "x"' || chr(10) || s_suppkey AS aliases FROM {supplier}""")
def organization_sheet_files(spark, sf):
    orgs = spark_sql(spark, sf, _ORGS).withColumn("aliases", F.array(F.concat(F.lit('A "x"\n'), "id")))
    folder = f"{work_folder(spark)}/organizations"
    tables.write_sheet(tables.cells(orgs, orgs.columns), folder)
    back = tables.restore_organizations(tables.read_sheet(spark, folder, orgs.columns))
    return back.select("id", "legal_name", "domain", "verification_confidence", "search_used", "verified_at", F.get("aliases", F.lit(0)).alias("aliases"))


_CHILD = "FROM {lineitem}"


@query("contact_sheet_files", """SELECT 'k' || l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS organization_id, 'Bà "' || l_partkey || '",' || chr(10) || 'x' AS full_name,
 CAST(l_partkey % 100 AS INT) AS decision_score, TIMESTAMP '2026-01-02 03:04:05' AS verified_at FROM {lineitem}""")
def contact_sheet_files(spark, sf):
    none = F.lit(None).cast("string")
    rows = spark_sql(spark, sf, "SELECT * FROM {lineitem}").select(
        F.concat(F.lit("k"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.col("l_suppkey").cast("string").alias("organization_id"),
        F.concat(F.lit('Bà "'), "l_partkey", F.lit('",\nx')).alias("full_name"), *[none.alias(c) for c in ("raw_title", "role_group", "email", "phone", "profile_url", "source_url", "evidence_text")],
        (F.col("l_partkey") % 100).cast("int").alias("decision_score"), none.alias("decision_reason"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz").alias("verified_at"))
    folder = f"{work_folder(spark)}/contacts"
    tables.write_sheet(tables.cells(rows, tables.names_of(CONTACTS)), folder)
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id FROM {supplier}")
    return tables.restore_contacts(tables.read_sheet(spark, folder, tables.names_of(CONTACTS)), orgs).select("id", "organization_id", "full_name", "decision_score", "verified_at")


@query("evidence_sheet_files", """SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS organization_id, l_returnflag AS field, 'a' || chr(10) || '"b"' AS evidence_text, l_discount AS confidence FROM {lineitem}""")
def evidence_sheet_files(spark, sf):
    rows = spark_sql(spark, sf, "SELECT * FROM {lineitem}").select(
        F.concat(F.lit("e"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.col("l_suppkey").cast("string").alias("organization_id"), F.col("l_returnflag").alias("field"),
        F.lit("v").alias("value"), F.lit("https://x").alias("source_url"), F.lit('a\n"b"').alias("evidence_text"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz").alias("crawled_at"), F.col("l_discount").alias("confidence"))
    folder = f"{work_folder(spark)}/evidence"
    tables.write_sheet(tables.cells(rows, tables.names_of(EVIDENCE)), folder)
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id FROM {supplier}")
    return tables.restore_evidence(tables.read_sheet(spark, folder, tables.names_of(EVIDENCE)), orgs, at(NOW)).select("id", "organization_id", "field", "evidence_text", "confidence")


_WORDS = ["camera", "phần mềm", "OCR"]
_SEARCHED = """SELECT o_orderkey, o_custkey, o_orderpriority, 'vnexpress' AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'camera' WHEN 1 THEN 'phần mềm' ELSE 'OCR' END AS keyword FROM {orders}"""


def _search_links(spark, sf):
    """Result pages of keyword searches: an article that speaks of the keyword, one that does not, a link to another host, one in the menu."""
    pages = spark_sql(spark, sf, f"""
SELECT 'https://timkiem.vnexpress.net/?q=' || CAST(o_orderkey AS STRING) AS url, source_id, keyword,
 '<html><body><nav><li>' || keyword || ' <a href="https://vnexpress.net/menu-1.html">Menu</a></li></nav>'
 || '<article><h3><a href="https://vnexpress.net/bai-' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 97 AS STRING) || '.html">Tin</a></h3><p>Hệ thống ' || upper(keyword) || ' mới</p></article>'
 || '<article><a href="https://vnexpress.net/khac-' || CAST(o_orderkey AS STRING) || '.html">Tin khác</a><p>Không liên quan</p></article>'
 || '<article><a href="https://other.example.com/bai-' || CAST(o_orderkey AS STRING) || '.html">' || keyword || '</a></article></body></html>' AS html
FROM ({_SEARCHED})""", spread="orders")
    return links.search_links(links.page_links(pages, keep=("source_id", "keyword"), with_context=True))


@query("search_links", f"""SELECT 'https://timkiem.vnexpress.net/?q=' || o_orderkey AS page_url, keyword, 'https://vnexpress.net/bai-' || o_custkey || '-' || (o_orderkey % 97) || '.html' AS target_url FROM ({_SEARCHED})""")
def search_links(spark, sf):
    return _search_links(spark, sf).select("page_url", "keyword", "target_url")


@query("search_links_balanced", f"""WITH found AS (SELECT keyword, 'https://vnexpress.net/bai-' || o_custkey || '-' || (o_orderkey % 97) || '.html' AS target_url FROM ({_SEARCHED})),
 k0 AS (SELECT DISTINCT target_url FROM found WHERE keyword = 'camera' ORDER BY 1 LIMIT 50),
 k1 AS (SELECT DISTINCT target_url FROM found WHERE keyword = 'phần mềm' AND target_url NOT IN (FROM k0) ORDER BY 1 LIMIT 50),
 k2 AS (SELECT DISTINCT target_url FROM found WHERE keyword = 'OCR' AND target_url NOT IN (FROM k0) AND target_url NOT IN (FROM k1) ORDER BY 1 LIMIT 50)
SELECT 'camera' AS keyword, target_url FROM k0 UNION ALL SELECT 'phần mềm', target_url FROM k1 UNION ALL SELECT 'OCR', target_url FROM k2""")
def search_links_balanced(spark, sf):
    """What each keyword may take of what was found, fifty pages each."""
    found = _search_links(spark, sf).select("source_id", "keyword", F.lit(0).alias("position"), "target_url")
    return ordering.balanced_top(found, _WORDS, per_keyword=50).select("keyword", "target_url")


@query("extraction_requests", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_url, 'extraction' AS kind, '- Nguồn: ' || CASE WHEN o_orderstatus = 'F' THEN 'không xác định' ELSE 'src' END || chr(10) || '- Keyword khớp: '
 || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ', camera' ELSE 'Không có keyword khớp được ghi nhận' END || chr(10) || '- Tiêu đề: T' || o_custkey || chr(10) || '- Nội dung gốc:' || chr(10) || 'C' || o_orderkey AS facts FROM {orders}""")
def extraction_requests(spark, sf):
    o, none = spark_sql(spark, sf, "SELECT * FROM {orders}"), F.array().cast("array<string>")
    items = o.select(F.col("o_orderkey").cast("string").alias("doc_url"), F.when(F.col("o_orderstatus") == "F", "").otherwise("src").alias("source_id"),
                     F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority", F.lit(" "), F.lit("camera"))).otherwise(none).alias("matched_keywords"),
                     F.concat(F.lit("T"), "o_custkey").alias("title"), F.concat(F.lit("C"), "o_orderkey").alias("raw_content"))
    return requests.extraction_requests(items).select("doc_url", "kind", F.element_at(F.split("request", "\n\n"), -1).alias("facts"))


def _asked(spark, sf):
    c = spark_sql(spark, sf, "SELECT * FROM {customer}")
    return c.select(F.col("c_custkey").cast("string").alias("doc_url"), F.col("c_name").alias("organization_name"), F.when(F.col("c_acctbal") > 0, "enterprise").alias("organization_type"),
                    F.when(F.col("c_nationkey") > 9, F.col("c_custkey").cast("string")).alias("organization_tax_code"), F.when(F.col("c_nationkey") < 5, "https://a.vn/").alias("official_url"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "Trang 1").alias("context"), F.when(F.col("c_mktsegment") == "MACHINERY", "Thêm").alias("supplement"), F.col("c_mktsegment").alias("location"))


@query("profile_requests", """SELECT CAST(c_custkey AS VARCHAR) AS doc_url, 'profile' AS kind, '- Tổ chức: ' || c_name || chr(10) || '- Loại tổ chức: ' || CASE WHEN c_acctbal > 0 THEN 'enterprise' ELSE 'Chưa rõ' END || chr(10)
 || '- Mã số thuế: ' || CASE WHEN c_nationkey > 9 THEN CAST(c_custkey AS VARCHAR) ELSE 'Chưa xác định' END || chr(10) || '- Website: ' || CASE WHEN c_nationkey < 5 THEN 'https://a.vn/' ELSE 'Không có' END || chr(10)
 || '- Trang đã đọc:' || chr(10) || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Trang 1' ELSE '(không có website chính thức)' END || CASE WHEN c_mktsegment = 'MACHINERY' THEN chr(10) || '- Bổ sung:' || chr(10) || 'Thêm' ELSE '' END AS facts FROM {customer}""")
def profile_requests(spark, sf):
    return requests.profile_requests(_asked(spark, sf)).select("doc_url", "kind", F.element_at(F.split("request", "\n\n"), -1).alias("facts"))


@query("query_requests", """SELECT CAST(c_custkey AS VARCHAR) AS doc_url, 'query' AS kind, '- Tổ chức: ' || c_name || chr(10) || '- Mã số thuế: ' || CASE WHEN c_nationkey > 9 THEN CAST(c_custkey AS VARCHAR) ELSE 'Không có' END
 || chr(10) || '- Địa điểm: ' || c_mktsegment AS facts FROM {customer}""")
def query_requests(spark, sf):
    return requests.query_requests(_asked(spark, sf)).select("doc_url", "kind", F.element_at(F.split("request", "\n\n"), -1).alias("facts"))


@query("search_queries", "SELECT CAST(c_custkey AS VARCHAR) AS doc_url, 'Công ty ' || c_name AS query FROM {customer} WHERE c_nationkey % 3 <> 0")
def search_queries(spark, sf):
    """The first usable query of an answer; answers without one give no row."""
    answers = spark_sql(spark, sf, """SELECT CAST(c_custkey AS STRING) AS doc_url, 'query' AS kind, CASE c_nationkey % 3 WHEN 0 THEN '{"queries": [" "]}'
 WHEN 1 THEN '{"queries": ["", "Công  ty ' || c_name || '", "b"]}' ELSE 'Kết quả: {"queries": ["Công ty ' || c_name || '"]}' END AS body FROM {customer}""")
    return responses.search_queries(answers)


@query("enrichment_plan", """SELECT CAST(c_custkey AS VARCHAR) AS doc_url, CASE c_nationkey % 5 WHEN 0 THEN 'ORGANIZATION_NOT_IDENTIFIED' WHEN 1 THEN 'SITE' ELSE 'SEARCH' END AS enrichment,
 CASE c_nationkey % 5 WHEN 1 THEN 'https://f' || c_custkey || '.example.com/' END AS official_url FROM {customer}""")
def enrichment_plan(spark, sf):
    """No name, an own site, a search engine's page, a private address, no site."""
    found = spark_sql(spark, sf, """SELECT CAST(c_custkey AS STRING) AS doc_url, CASE WHEN c_nationkey % 5 = 0 THEN ' ' ELSE c_name END AS organization_name,
 CASE c_nationkey % 5 WHEN 0 THEN 'https://a.vn/' WHEN 1 THEN 'https://F' || CAST(c_custkey AS STRING) || '.example.com/gioi-thieu?utm_source=x' WHEN 2 THEN 'https://www.google.com/search?q=a' WHEN 3 THEN 'http://10.0.0.1/' END AS organization_website FROM {customer}""")
    return profiles.enrichment_plan(found).select("doc_url", "enrichment", "official_url")


@query("replay_contents", """SELECT id, source_url, title, CASE WHEN position % 2 = 0 THEN 'Toàn văn ' || id ELSE title END AS raw_content FROM {v_leads} WHERE status = 'PENDING_AI'""")
def replay_contents(spark, sf):
    base = leads(spark, sf).withColumn("raw_content_ref", F.concat(F.lit("snap/"), F.col("id")))
    snapshots = base.where("position % 4 <> 1").select(F.col("raw_content_ref").alias("snapshot_path"), F.when(F.col("position") % 2 == 0, F.concat(F.lit("Toàn văn "), "id")).otherwise("").alias("visible_text"))
    return ops.replay_contents(base, snapshots)


_PROFILE_ROWS = """SELECT CAST(l_suppkey AS STRING) AS organization_id, CAST(DATE '2026-01-01' AS {TS}) AS verified_at, l_linenumber, l_partkey, l_orderkey FROM {lineitem}"""


@query("contact_rows", """SELECT left(sha256(l_suppkey || '|P' || (l_partkey % 5) || '||https://s/' || n), 36) AS id, CAST(l_suppkey AS VARCHAR) AS organization_id, 'P' || (l_partkey % 5) AS full_name, 'https://s/' || n AS source_url
FROM {lineitem}, (SELECT 'a' AS n UNION ALL SELECT 'b') GROUP BY ALL""")
def contact_rows(spark, sf):
    """Two contacts for each profile; the same person of an organization is one row."""
    def person(page: str):
        return F.struct(F.concat(F.lit("P"), F.col("l_partkey") % 5).alias("full_name"), F.lit(None).cast("string").alias("raw_title"), F.lit(f"https://s/{page}").alias("source_url"))
    made = spark_sql(spark, sf, _PROFILE_ROWS).withColumn("contacts", F.array(person("a"), person("b")))
    return resolve.contact_rows(made).select("id", "organization_id", "full_name", "source_url")


@query("evidence_rows", """SELECT left(sha256(l_suppkey || '|industry|https://s/' || (l_partkey % 3) || '|t' || l_linenumber), 36) AS id, CAST(l_suppkey AS VARCHAR) AS organization_id, 'industry' AS field,
 't' || l_linenumber AS evidence_text, TIMESTAMP '2026-01-01 00:00:00' AS crawled_at FROM {lineitem} GROUP BY l_suppkey, l_partkey % 3, l_linenumber""")
def evidence_rows(spark, sf):
    item = F.struct(F.lit("industry").alias("field"), F.concat(F.lit("https://s/"), F.col("l_partkey") % 3).alias("source_url"), F.concat(F.lit("t"), "l_linenumber").alias("evidence_text"))
    made = spark_sql(spark, sf, _PROFILE_ROWS).withColumn("evidence", F.array(item))
    return resolve.evidence_rows(made).select("id", "organization_id", "field", "evidence_text", "crawled_at")


@query("collections_regrouped", """SELECT CAST(l_suppkey AS VARCHAR) AS organization_id, string_agg(CASE WHEN l_linenumber <= 3 THEN 'p' || l_partkey END, '|' ORDER BY l_orderkey * 10 + l_linenumber, '{"name":"p' || l_partkey || '"}') AS projects,
 string_agg(CASE WHEN l_linenumber > 3 THEN 'T' || l_linenumber END, '|' ORDER BY l_orderkey * 10 + l_linenumber) AS news FROM {lineitem} WHERE l_suppkey IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 1000) GROUP BY l_suppkey""")
def collections_regrouped(spark, sf):
    """Collection rows of existing organizations as one array for each kind, in sheet order."""
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id FROM {supplier} WHERE s_acctbal > 1000")
    cells = spark_sql(spark, sf, """SELECT CAST(l_suppkey AS STRING) AS organization_id, CASE WHEN l_linenumber > 3 THEN 'news' ELSE 'projects' END AS kind, l_orderkey * 10 + l_linenumber AS position,
 CASE WHEN l_linenumber > 3 THEN '' ELSE '{"name":"p' || CAST(l_partkey AS STRING) || '"}' END AS payload, 'T' || CAST(l_linenumber AS STRING) AS title, CAST(NULL AS STRING) AS summary, CAST(NULL AS STRING) AS published_at,
 'https://x' AS source_url FROM {lineitem}""")
    made = tables.restored_collections(cells, orgs)

    def joined(kind: str, field: str):
        return F.nullif(F.array_join(F.transform(kind, lambda v: v[field]), "|"), F.lit("")).alias(kind)
    return made.select("organization_id", joined("projects", "name"), joined("news", "title"))


@query("lead_detail", """WITH one AS (SELECT * FROM {v_leads} WHERE id = (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM {orders} JOIN {lineitem} ON l_suppkey = o_custkey))
SELECT 'lead' AS part, 0 AS place, id, s_name AS label FROM one LEFT JOIN {supplier} ON CAST(s_suppkey AS VARCHAR) = organization_id
UNION ALL SELECT 'contact', CAST(row_number() OVER (ORDER BY decision_score DESC NULLS LAST, CAST(c.position AS VARCHAR)) AS INT), CAST(c.position AS VARCHAR), full_name FROM {v_contacts} c JOIN one USING (organization_id)
UNION ALL SELECT 'evidence', CAST(row_number() OVER (ORDER BY 'e' || o_orderkey) AS INT), 'e' || o_orderkey, o_orderpriority FROM {orders} JOIN one ON CAST(o_custkey AS VARCHAR) = organization_id""")
def lead_detail(spark, sf):
    """Profile, contacts and evidence shown for one lead, in the order shown."""
    which = spark_sql(spark, sf, "SELECT CAST(min(o_orderkey) AS STRING) AS id FROM {orders} JOIN {lineitem} ON l_suppkey = o_custkey").first()["id"]
    none = F.lit(None).cast("string")
    orgs = spark_sql(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS id, s_name AS legal_name FROM {supplier}").withColumns(
        {c: none for c in ("domain", "tax_code", "profile_status", "industry", "size", "employee_count", "official_url")})
    contacts = spark_sql(spark, sf, "SELECT CAST(position AS STRING) AS id, organization_id, full_name, decision_score FROM {v_contacts}")
    evidence = spark_sql(spark, sf, "SELECT 'e' || CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS organization_id, o_orderpriority FROM {orders}")
    shown = search.lead_detail(leads(spark, sf), orgs, contacts, evidence, which)

    def placed(rows, part: str, label: str):
        listed = rows.agg(F.collect_list(F.struct("id", F.col(label).alias("label"))).alias("l"))  # of one lead, in its order
        return listed.select(F.lit(part).alias("part"), F.posexplode("l").alias("place", "r")).select("part", (F.col("place") + 1).cast("int").alias("place"), "r.id", "r.label")
    return shown["lead"].select(F.lit("lead").alias("part"), F.lit(0).alias("place"), "id", F.col("legal_name").alias("label")).unionByName(
        placed(shown["contacts"], "contact", "full_name")).unionByName(placed(shown["evidence"], "evidence", "o_orderpriority"))
