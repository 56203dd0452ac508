"""Queries over pages, documents and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.catalog import query, spark_sql
from opporta.functions import addresses, phones, text as tx, url
from opporta.operators import dedup, documents, feeds, links, match, parse, rule_based, walk


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark_sql(spark, sf, "SELECT * FROM {v_raw}", spread="pages")


@query("load_raw_documents", """
SELECT url, source_id, left(sha256(url), 16) AS snapshot_hash, strftime(fetched_at, '%Y%m%d') AS snapshot_day,
 source_id || '/' || strftime(fetched_at, '%Y%m%d') || '/' || left(sha256(url), 16) || '.html' AS snapshot_path, length(html) AS n_chars
FROM {v_raw}""")
def load_raw_documents(spark, sf):
    return documents.with_snapshot_path(raw(spark, sf)).select(
        "url", "source_id", "snapshot_hash", "snapshot_day", "snapshot_path", F.length("html").alias("n_chars"))


_GATE = """SELECT page_id, source_id, CASE WHEN status_code >= 400 THEN 'http_error' WHEN trim(body) = '' THEN 'empty'
 WHEN regexp_matches(lower(body), 'cf-chl-|challenges\\.cloudflare\\.com|just a moment|verify you are human|checking your browser') THEN 'challenge'
 WHEN content_type IS NOT NULL AND NOT regexp_matches(lower(content_type), 'html|xml|text') THEN 'content_type' END AS reject_reason FROM {v_raw}"""


def gated(spark, sf):
    headers = F.create_map(F.lit("Content-Type"), F.col("content_type"))
    pages = raw(spark, sf).drop("html").withColumnRenamed("body", "html").withColumn("headers", headers)
    return documents.quality_gate(pages, window=None)


@query("quality_gate", _GATE)
def quality_gate(spark, sf):
    return gated(spark, sf).select("page_id", "source_id", "reject_reason")


@query("rejects_by_source", f"SELECT source_id, coalesce(reject_reason, 'accepted') AS reason, count(*) AS pages FROM ({_GATE}) GROUP BY ALL")
def rejects_by_source(spark, sf):
    return documents.rejects_by_source(gated(spark, sf))


_CANONICAL = r"""lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1))
 || CASE WHEN length(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) > 1
    THEN rtrim(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') ELSE regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p:
    regexp_matches(p, '^[^=]*=.') AND NOT regexp_matches(lower(p), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|ref|fbclid|gclid)=')), '&'), ''), '')"""


@query("dedup_url_feed", "SELECT c AS canonical_url, sha256(c) AS fingerprint, count(*) AS copies, min(page_id) AS page_id FROM (SELECT "
       + _CANONICAL.replace("{u}", "url") + " AS c, page_id FROM {v_url_feed}) GROUP BY c")
def dedup_url_feed(spark, sf):
    feed = spark_sql(spark, sf, "SELECT * FROM {v_url_feed}")
    return dedup.dedup_urls(feed, ["page_id", "variant"]).select("canonical_url", "fingerprint", "copies", "page_id")


@query("new_documents", "SELECT DISTINCT c AS canonical_url FROM (SELECT " + _CANONICAL.replace("{u}", "url") + """ AS c FROM {v_url_feed})
 WHERE c NOT IN (SELECT """ + _CANONICAL.replace("{u}", "url") + " FROM {v_raw} WHERE status_code < 400 AND content_type IS NOT NULL)")
def new_documents(spark, sf):
    """Distinct feed URLs that are not stored yet."""
    feed = spark_sql(spark, sf, "SELECT * FROM {v_url_feed}")
    known = dedup.with_fingerprint(raw(spark, sf).where("status_code < 400 AND content_type IS NOT NULL").select("url"))
    return dedup.not_known(dedup.dedup_urls(feed, ["page_id", "variant"]), known).select("canonical_url")


@query("page_links", r"""
WITH found AS (SELECT url AS page_url, lower(regexp_extract(url, '^([a-z]+://[^/]*)', 1)) AS root,
  regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM {pages}),
 one AS (SELECT page_url, root, unnest(range(len(hrefs))) AS position, hrefs, texts FROM found)
SELECT page_url, position, hrefs[position + 1] AS href, trim(regexp_replace(texts[position + 1], '\s+', ' ', 'g')) AS text, TRUE AS in_chrome,
 root || CASE WHEN length(hrefs[position + 1]) > 1 THEN rtrim(hrefs[position + 1], '/') ELSE hrefs[position + 1] END AS target_url FROM one""")
def page_links(spark, sf):
    return links.page_links(raw(spark, sf)).select(
        "page_url", F.col("position").cast("bigint").alias("position"), "href", "text", "in_chrome", "target_url")


@query("site_edges", r"""
WITH found AS (SELECT """ + _CANONICAL.replace("{u}", "url") + r""" AS src_url, lower(regexp_extract(url, '^([a-z]+://[^/]*)', 1)) AS root,
  regexp_replace(lower(regexp_extract(url, '://([^/]*)', 1)), '^www\.', '') AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM {pages})
SELECT DISTINCT site, src_url, root || CASE WHEN length(href) > 1 THEN rtrim(href, '/') ELSE href END AS dst_url FROM found WHERE href <> ''""")
def site_edges(spark, sf):
    return links.site_edges(links.page_links(raw(spark, sf))).select("site", "src_url", "dst_url")


@query("parsed_titles", r"""
SELECT url, left(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), 500) AS title, CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS VARCHAR) AS error FROM {pages}""")
def parsed_titles(spark, sf):
    return parse.parse_items(raw(spark, sf), at("2026-08-23 00:00:00")).select("url", "title", "published_at", "error")


# The given pages are regular: no markup inside attributes, five character references, no links to mail or phones.
_BODY_TEXT = r"""SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(flat, '(?m)^\s{0,3}#{1,6}\s*', '', 'g'),
 '(?m)^\s*>\s?', '', 'g'), '`', '', 'g'), '\*\*|__|~~', '', 'g'), '(?m)^\s*[*+-]\s+', '', 'g'), '\s+', ' ', 'g')) AS body_text
FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '[ \t]+', ' ', 'g')) AS flat FROM {v_raw})"""


@query("parsed_items", r"""
SELECT url, source_id, left(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), 500) AS title, body_text AS raw_content, CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS VARCHAR) AS error
FROM (""" + _BODY_TEXT + ")")
def parsed_items(spark, sf):
    """Whole items with their text."""
    items = parse.parse_items(raw(spark, sf), at("2026-08-23 00:00:00"))
    return items.select("url", "source_id", "title", "raw_content", "published_at", "error")


@query("published_dates", """
SELECT url, CASE o_orderpriority WHEN '2-HIGH' THEN o_orderdate + INTERVAL '450' MINUTE WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL '495' MINUTE
 WHEN '5-LOW' THEN NULL ELSE o_orderdate END AS published_at
FROM (SELECT *, 'https://news.example.com/a/' || CAST(o_orderkey AS VARCHAR) AS url FROM {v_orders_text})""")
def published_dates(spark, sf):
    pages = spark_sql(spark, sf, "SELECT * FROM {v_articles}", spread="orders")
    return parse.parse_items(pages, at("2026-08-23 00:00:00")).select("url", "published_at")


def job_pages(spark, sf):
    return spark_sql(spark, sf, """
SELECT 'https://www.topcv.vn/viec-lam/x/' || CAST(c_custkey AS STRING) || '.html' AS url, 'topcv' AS source_id, TIMESTAMP_NTZ '2026-08-01 00:00:00' AS fetched_at,
 '<html><head>' || CASE c_mktsegment WHEN 'BUILDING' THEN '<script type="application/ld+json">[{"@type":"WebSite"},{"@type":"JobPosting","title":"Job '
   || c_name || '","datePosted":"2026-08-0' || CAST(1 + c_nationkey % 9 AS STRING) || '","hiringOrganization":{"name":"Firm ' || CAST(c_nationkey AS STRING) || '"}}]</script>'
  WHEN 'MACHINERY' THEN '<script type="application/ld+json">{broken</script>' ELSE '' END || '</head><body>'
 || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE '<h1>Head <b>' || c_name || '</b></h1>' END
 || '<div class="x company-name-label">Node ' || CAST(c_custkey AS STRING) || '</div><p>Ngày đăng: 0' || CAST(1 + c_nationkey % 9 AS STRING) || '/07/2026</p></body></html>' AS html
FROM {customer}""", spread="customer")


@query("job_posts", """
SELECT 'https://www.topcv.vn/viec-lam/x/' || CAST(c_custkey AS VARCHAR) || '.html' AS url,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Job ' || c_name WHEN 'HOUSEHOLD' THEN NULL ELSE 'Head ' || c_name END AS title,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Firm ' || CAST(c_nationkey AS VARCHAR) ELSE 'Node ' || CAST(c_custkey AS VARCHAR) END AS author,
 CASE c_mktsegment WHEN 'BUILDING' THEN make_timestamp(2026, 8, 1 + c_nationkey % 9, 0, 0, 0) ELSE make_timestamp(2026, 7, 1 + c_nationkey % 9, 0, 0, 0) END AS published_at,
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'no title' END AS error FROM {customer}""")
def job_posts(spark, sf):
    return parse.parse_items(job_pages(spark, sf), at("2026-08-23 00:00:00")).select("url", "title", "author", "published_at", "error")


@query("job_cards", """
SELECT 'https://www.topcv.vn/viec-lam/a/' || CAST(c_custkey AS VARCHAR) || '.html' AS url, 'Job ' || c_name AS title, 'Firm ' || c_mktsegment AS company,
 TIMESTAMP '2026-08-23 12:00:00' - INTERVAL '1' DAY * CASE c_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN c_nationkey WHEN 3 THEN 7 * c_nationkey ELSE 30 * c_nationkey END AS published_at
FROM {customer}""")
def job_cards(spark, sf):
    listings = spark_sql(spark, sf, """
SELECT 'https://www.topcv.vn/tim-viec-lam?page=' || CAST(c_custkey AS STRING) AS url, TIMESTAMP_NTZ '2026-08-23 12:00:00' AS fetched_at,
 '<div class="job-item-2"><h3 class="title"><a href="/viec-lam/a/' || CAST(c_custkey AS STRING) || '.html?ta=1#x"> Job ' || c_name || '</a></h3><a class="company">Pro Firm '
 || c_mktsegment || '</a><label>' || CASE c_nationkey % 5 WHEN 0 THEN 'Hôm nay' WHEN 1 THEN 'Hôm qua' WHEN 2 THEN CAST(c_nationkey AS STRING) || ' ngày trước'
  WHEN 3 THEN CAST(c_nationkey AS STRING) || ' tuần trước' ELSE CAST(c_nationkey AS STRING) || ' tháng trước' END
 || '</label></div><div class="job-item"><a href="/viec-lam/a/' || CAST(c_custkey AS STRING) || '.html">again</a></div><div class="job-item"><a href="/cong-ty/1">firm</a></div>' AS html
FROM {customer}""", spread="customer")
    return feeds.job_cards(listings, at("2026-08-23 12:00:00")).select("url", "title", "company", "published_at")


@query("social_posts", r"""
WITH posts AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM {conversations} WHERE role <> 'system'),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM posts WHERE content <> '')
SELECT 'https://www.linkedin.com/posts/' || CAST(conv_id AS VARCHAR) AS url, left(content, 220) AS title,
 content || chr(10) || 'Tác giả công khai: U' || CAST(conv_id AS VARCHAR) || chr(10) || 'Chức danh công khai: ' || role || chr(10)
 || 'Đơn vị công khai: C' || CAST(conv_id % 7 AS VARCHAR) AS raw_content,
 make_timestamp(1767225600000000 + conv_id * 3600000000) AS published_at, 'U' || CAST(conv_id AS VARCHAR) AS author FROM firsts WHERE rn = 1""")
def social_posts(spark, sf):
    """Turns as posts: all turns of a conversation share one URL, system turns sit on another site."""
    turns = spark_sql(spark, sf, "SELECT * FROM {conversations}", spread="conversations")
    cid = F.col("conv_id").cast("string")
    link = F.concat(F.when(F.col("role") == "system", "https://other.example.com/").otherwise("https://www.linkedin.com/posts/"), cid)
    body = F.to_json(F.struct(
        link.alias("postUrl"), F.struct(F.col("text")).alias("content"),
        F.struct(F.concat(F.lit("U"), cid).alias("name"), F.col("role").alias("headline"),
                 F.struct(F.concat(F.lit("C"), (F.col("conv_id") % 7).cast("string")).alias("name")).alias("company")).alias("author"),
        F.when(F.col("conv_id") % 2 == 0, F.lit(1767225600000) + F.col("conv_id") * 3600000)
        .otherwise(F.lit(1767225600) + F.col("conv_id") * 3600).alias("postedAt")))
    posts = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), body.alias("body"))
    return feeds.social_posts(posts, at("2026-08-23 00:00:00")).select("url", "title", "raw_content", "published_at", "author")


@query("search_results", """
SELECT c_name AS query, 2 AS position, 'Site ' || c_name AS title, 'https://c' || CAST(c_custkey AS VARCHAR) || '.example.com/' AS url, c_mktsegment AS snippet FROM {customer}
UNION ALL SELECT c_name, 4, 'n' || CAST(c_nationkey AS VARCHAR) || '.example.org', 'https://n' || CAST(c_nationkey AS VARCHAR) || '.example.org', 'see https://n' || CAST(c_nationkey AS VARCHAR) || '.example.org.' FROM {customer}""")
def search_results(spark, sf):
    """A search-engine hit, the site (twice), a private address, and a URL named in the answer."""
    c = spark_sql(spark, sf, "SELECT * FROM {customer}", spread="customer")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    site = F.concat(F.lit("https://c"), k, F.lit(".example.com/?utm_source=s"))
    body = F.to_json(F.struct(
        F.struct(F.array(
            F.to_json(F.struct(F.lit("https://www.google.com/search?q=x").alias("link"))),
            F.to_json(F.struct(F.struct(site.alias("href")).alias("url"), F.concat(F.lit("Site "), F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("content"))),
            F.to_json(F.struct(site.alias("url"))), F.to_json(F.struct(F.lit("http://10.0.0.1/x").alias("uri")))).alias("items")).alias("results"),
        F.struct(F.concat(F.lit("see https://n"), n, F.lit(".example.org.")).alias("text")).alias("answer")))
    responses = c.select(F.col("c_name").alias("query"), body.alias("body"))
    # Items travel as JSON text inside the list, as gateways that double-encode send them.
    fixed = responses.withColumn("body", F.regexp_replace(F.regexp_replace(F.replace("body", F.lit('\\"'), F.lit('"')), r'"\{', "{"), r'\}"', "}"))
    return feeds.search_results(fixed).select("query", "position", "title", "url", "snippet")


@query("section_links", """
SELECT 'vnexpress' AS source_id, '/so-hoa/bai-' || CAST(o_orderkey AS VARCHAR) || '.html' AS path, 'https://list.example.com/' || CAST(o_custkey AS VARCHAR) AS page_url FROM {orders}
UNION ALL SELECT 'baodauthau', '/goi-thau/muasam-post' || CAST(o_orderkey AS VARCHAR) || '.html', 'https://list.example.com/' || CAST(o_custkey AS VARCHAR) FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def section_links(spark, sf):
    """Section pages with an item link, a repeat of it, and links no rule accepts."""
    pages = spark_sql(spark, sf, """
SELECT 'https://list.example.com/' || CAST(o_custkey AS STRING) AS url, s.source_id, o_orderdate AS fetched_at,
 '<ul><li><a href="' || CASE s.source_id WHEN 'vnexpress' THEN '/so-hoa/bai-' ELSE '/goi-thau/muasam-post' END || CAST(o_orderkey AS STRING) || '.html">A</a> ' || day_vn
 || '</li><li><a href="/the-thao/bai.html">no</a></li><li><a href="/thong-bao-moi-thau/">menu</a></li></ul><div><a href="'
 || CASE s.source_id WHEN 'vnexpress' THEN '/so-hoa/bai-' ELSE '/goi-thau/muasam-post' END || CAST(o_orderkey AS STRING) || '.html"> ' || day_vn || '</a></div>' AS html
FROM (SELECT *, explode(array('vnexpress', 'baodauthau')) AS source_id FROM {v_orders_text}) AS s""", spread="orders")
    found = links.section_links(links.page_links(pages, fields=links.SECTION_FIELDS), at("2026-08-23 00:00:00"), at("1998-01-01 00:00:00"))
    return found.select("source_id", F.regexp_replace("full_url", r"^https://[^/]*", "").alias("path"), "page_url")


@query("site_walk", """
WITH RECURSIVE reach(site_no, page_no, depth) AS (
 SELECT site_no, min(page_no), 0 FROM {v_sites} GROUP BY site_no
 UNION SELECT e.site_no, e.dst, r.depth + 1 FROM reach r JOIN {v_sites} p ON p.page_no = r.page_no AND p.c_acctbal > -500 JOIN {v_site_edges} e ON e.src = r.page_no WHERE r.depth < 3)
SELECT 'site' || CAST(p.site_no AS VARCHAR) AS site, p.url, CAST(min(r.depth) AS INT) AS depth FROM reach r JOIN {v_sites} p ON p.page_no = r.page_no WHERE p.c_acctbal > -500 GROUP BY p.site_no, p.url""")
def site_walk(spark, sf):
    """Home page is the first page of each site; pages of customers far in debt cannot be read."""
    sites = spark_sql(spark, sf, "SELECT 'site' || CAST(site_no AS STRING) AS site, * FROM {v_sites}")
    edges = spark_sql(spark, sf, "SELECT 'site' || CAST(site_no AS STRING) AS site, src_url, dst_url, position FROM {v_site_edges}")
    seeds = sites.groupBy("site").agg(F.min_by("url", "page_no").alias("url")).withColumn("position", F.lit(0))
    return walk.site_walk(seeds, edges, sites.where("c_acctbal > -500")).select("site", "url", "depth")


_RANKED = """SELECT *, row_number() OVER (PARTITION BY site_no ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, length(link), link) AS rank
 FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN url || '/about' ELSE url END AS link FROM {v_sites})"""


@query("site_context", f"""SELECT site_no, count(*) AS pages_used, string_agg('URL: ' || link || chr(10) || 'Tiêu đề: ' || c_name || chr(10) || 'Nội dung: ' || c_mktsegment,
 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ({_RANKED}) WHERE rank <= 20 GROUP BY site_no""")
def site_context(spark, sf):
    pages = spark_sql(spark, sf, """SELECT site_no, CASE WHEN c_mktsegment = 'BUILDING' THEN url || '/about' ELSE url END AS url, c_name AS title, c_mktsegment AS raw_content FROM {v_sites}""")
    return walk.site_context(pages, "site_no")


@query("candidate_blocks", """
WITH loaded AS (SELECT l_orderkey, max(l_partkey * 100 + l_suppkey) AS best FROM {lineitem} GROUP BY l_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS query, o_orderkey AS position, best IS NOT NULL AS loaded,
 '[URL ' || o_orderkey || ']' || chr(10) || 'URL: https://r' || o_orderkey || '.example.com/a?ref=x' || chr(10) || 'Tiêu đề: ' || o_orderpriority || chr(10) || 'Đoạn trích: '
 || chr(10) || 'Nội dung tải được: ' || coalesce('text ' || best, '(không tải được)') AS block FROM {orders} LEFT JOIN loaded ON l_orderkey = o_orderkey""")
def candidate_blocks(spark, sf):
    results = spark_sql(spark, sf, """SELECT CAST(o_custkey AS STRING) AS query, o_orderkey AS position, 'https://r' || CAST(o_orderkey AS STRING) || '.example.com/a?ref=x' AS url,
 o_orderpriority AS title, CAST(NULL AS STRING) AS snippet FROM {orders}""")
    pages = spark_sql(spark, sf, """SELECT 'https://r' || CAST(l_orderkey AS STRING) || '.example.com/a/' AS source_url, 'https://final.example.com/' || CAST(l_orderkey AS STRING) AS url,
 l_partkey * 100 + l_suppkey AS position, 'text ' || CAST(l_partkey * 100 + l_suppkey AS STRING) AS text FROM {lineitem}""")
    return walk.candidate_blocks(results, pages).select("query", "position", "loaded", "block")


@query("retry_exclusion", """SELECT o_orderkey FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R')""")
def retry_exclusion(spark, sf):
    results = spark_sql(spark, sf, "SELECT o_orderkey, 'https://r' || CAST(o_orderkey AS STRING) || '.example.com/a?ref=x' AS url FROM {orders}")
    tried = spark_sql(spark, sf, "SELECT 'https://R' || CAST(l_orderkey AS STRING) || '.example.com/a/' AS url FROM {lineitem} WHERE l_returnflag = 'R'")
    return walk.not_attempted(results, tried).select("o_orderkey")


_IP_URL = """SELECT o_orderkey, CASE o_orderpriority
 WHEN '1-URGENT' THEN 'http://' || CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.0.1/a'
 WHEN '2-HIGH' THEN 'ftp://example.com/' || CAST(o_orderkey AS STRING) WHEN '3-MEDIUM' THEN 'https://user:pw@example.com/' || CAST(o_orderkey AS STRING)
 WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'https://LOCALHOST:8080/x' WHEN o_orderkey % 3 = 1 THEN 'https://h' || CAST(o_orderkey AS STRING) || '.local' ELSE 'http://[::1]/' END
 ELSE 'https://www.h' || CAST(o_orderkey AS STRING) || '.example.com/p?q=1' END AS url, o_orderkey % 256 AS a, o_custkey % 256 AS b, o_orderpriority FROM {orders}"""


@query("public_url_check", f"""SELECT o_orderkey, url, CASE o_orderpriority WHEN '2-HIGH' THEN 'Chỉ hỗ trợ URL HTTP hoặc HTTPS'
 WHEN '3-MEDIUM' THEN 'URL không được chứa username hoặc password'
 WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 3 = 2 THEN 'Không cho phép địa chỉ mạng nội bộ hoặc dành riêng' ELSE 'Không cho phép địa chỉ nội bộ' END
 WHEN '1-URGENT' THEN CASE WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b BETWEEN 18 AND 19)
  THEN 'Không cho phép địa chỉ mạng nội bộ hoặc dành riêng' END END AS reason FROM ({_IP_URL})""")
def public_url_check(spark, sf):
    return spark_sql(spark, sf, _IP_URL, spread="orders").select("o_orderkey", "url", addresses.url_problem(F.col("url")).alias("reason"))


@query("doc_contacts", r"""
SELECT doc_id, nullif(regexp_extract(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'), '') AS email,
 CASE WHEN length(d) = 10 AND regexp_matches(d, '^0[35789]') OR length(d) = 11 AND d LIKE '02%' THEN d END AS phone
FROM (SELECT doc_id, text, regexp_replace(regexp_extract(regexp_replace(text, '[\s.-]', '', 'g'), '(?:\+84|0)(?:[35789][0-9]{8}|2[0-9]{9})'), '^\+84', '0') AS d FROM {documents})""")
def doc_contacts(spark, sf):
    docs = spark_sql(spark, sf, "SELECT doc_id, text FROM {documents}", spread="documents")
    return docs.select("doc_id", phones.first_email(F.col("text")).alias("email"), phones.first_phone(F.col("text")).alias("phone"))


# Words of the test documents, in three groups.
KEYWORDS = [
    ("the", "English"), ("and", "English"), ("that", "English"), ("with", "English"), ("of the", "English"), ("in the", "English"), ("worthless", "English"),
    ("le", "French"), ("que", "French"), ("pour", "French"), ("dans", "French"), ("de la", "French"), ("qui", "French"),
    ("der", "German"), ("und", "German"), ("für", "German"), ("in der", "German"), ("para", "German"), ("los", "Spanish"), ("con", "Spanish"),
]


def keywords(spark):
    return spark.createDataFrame([(k, g, g, True, True, True) for k, g in KEYWORDS],
                                 "keyword STRING, group_id STRING, group_name STRING, use_for_filter BOOLEAN, use_for_discovery BOOLEAN, active BOOLEAN")


_HITS = r"""SELECT doc_id, keyword, grp FROM {documents}, (VALUES """ + ", ".join(f"('{k}', '{g}')" for k, g in KEYWORDS) + r""") AS k(keyword, grp)
 WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || keyword || '($|[^\p{L}\p{N}_])')"""


def matched(spark, sf, inline_limit=match.INLINE_LIMIT):
    docs = spark_sql(spark, sf, "SELECT doc_id, '' AS title, text AS raw_content FROM {documents}", spread="documents")
    return match.match_keywords(docs, keywords(spark), "doc_id", inline_limit)


_MATCHED = f"""SELECT doc_id, coalesce(string_agg(keyword, '|' ORDER BY keyword), '') AS matched_keywords, coalesce(string_agg(DISTINCT grp, '|' ORDER BY grp), '') AS matched_groups,
 count(keyword) > 0 AS is_relevant FROM {{documents}} LEFT JOIN ({_HITS}) USING (doc_id) GROUP BY doc_id"""


def _matched_text(df):
    return df.select("doc_id", F.array_join("matched_keywords", "|").alias("matched_keywords"), F.array_join("matched_groups", "|").alias("matched_groups"), "is_relevant")


@query("keyword_matches", _MATCHED)
def keyword_matches(spark, sf):
    return _matched_text(matched(spark, sf))


@query("keyword_matches_large_registry", _MATCHED)
def keyword_matches_large_registry(spark, sf):
    """The joined plan, used when the registry is too large to be part of the plan."""
    return _matched_text(matched(spark, sf, inline_limit=0))


@query("keyword_groups", f"SELECT grp AS group_name, count(DISTINCT doc_id) AS documents FROM ({_HITS}) GROUP BY grp")
def keyword_groups(spark, sf):
    return matched(spark, sf).select(F.explode("matched_groups").alias("group_name")).groupBy("group_name").agg(F.count("*").alias("documents"))


def tender_texts(spark, sf):
    return spark_sql(spark, sf, """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'Bộ ' || CAST(o_custkey AS STRING) || ': ban hành' ELSE 'Gói thầu ' || CAST(o_orderkey AS STRING) END AS title,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Chủ đầu tư: Trung tâm số ' || CAST(o_custkey AS STRING) || chr(10) ELSE '' END
 || CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Công ty số ' || CAST(o_custkey AS STRING) || ' triển khai hệ thống camera giám sát. ' ELSE 'Tin ngắn. ' END
 || 'Giá trị ' || CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS STRING) || ' tỷ 500 triệu đồng' WHEN 'O' THEN CAST(o_orderkey AS STRING) || ' triệu đồng' ELSE 'chưa rõ' END
 || '. Địa điểm ' || CASE o_custkey % 4 WHEN 0 THEN 'Quảng Ninh và Hà Nội' WHEN 1 THEN 'thành phố Hồ Chí Minh' WHEN 2 THEN 'Đà Nẵng' ELSE 'toàn quốc' END
 || ', hạn nộp ' || day_vn || ' 09:00, email a' || CAST(o_custkey AS STRING) || '@example.vn, điện thoại 09' || lpad(CAST(o_custkey AS STRING), 8, '0') AS raw_content
FROM {v_orders_text}""", spread="orders")


@query("rule_extraction", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Trung tâm số ' || o_custkey WHEN o_orderpriority = '3-MEDIUM' THEN 'Công ty số ' || o_custkey
  WHEN o_orderpriority = '5-LOW' THEN 'Bộ ' || o_custkey END AS organization_name,
 CASE o_orderstatus WHEN 'F' THEN o_orderkey * 1e9 + 5e8 WHEN 'O' THEN o_orderkey * 1e6 END AS budget_value,
 CASE o_custkey % 4 WHEN 0 THEN 'Hà Nội' WHEN 1 THEN 'TP.HCM' WHEN 2 THEN 'Đà Nẵng' END AS location, o_orderdate + INTERVAL '9' HOUR AS deadline,
 'a' || o_custkey || '@example.vn' AS contact_email, CASE WHEN o_custkey < 100000000 THEN '09' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS contact_phone,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Công ty số ' || o_custkey || ' triển khai hệ thống camera giám sát.' WHEN o_orderpriority = '5-LOW' THEN 'Bộ ' || o_custkey || ': ban hành.'
  ELSE 'Gói thầu ' || o_orderkey || '.' END AS need_summary FROM {v_orders_text}""")
def rule_extraction(spark, sf):
    return rule_based.extract_by_rules(tender_texts(spark, sf), at("2026-08-23 00:00:00")).select(
        "o_orderkey", "organization_name", "budget_value", "location", "deadline", "contact_email", "contact_phone", "need_summary")


@query("grounded_website", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN contains(lower(html), regexp_replace(h, '^www\.', '')) THEN 'https://' || h END AS organization_website
 FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 1 THEN source_id ELSE 'invented' || page_id || '.com' END AS h FROM {v_raw})""")
def grounded_website(spark, sf):
    from opporta.operators import responses
    pages = raw(spark, sf)
    claimed = F.when(F.col("page_id") % 3 == 1, F.col("source_id")).when(F.col("page_id") % 3 == 2, F.concat(F.lit("invented"), F.col("page_id").cast("string"), F.lit(".com")))
    extracted = pages.select("page_id", F.col("page_id").alias("doc_url"), F.concat(F.lit("https://"), claimed).alias("organization_website"))
    return responses.grounded_website(extracted, pages.select(F.col("page_id").alias("doc_url"), F.col("html").alias("raw_content"))).select("page_id", "organization_website")


@query("grounded_records", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem} a WHERE EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_returnflag = 'R' AND a.l_orderkey = b.l_orderkey AND a.l_partkey % 10 = b.l_partkey % 10)""")
def grounded_records(spark, sf):
    from opporta.operators import profiles
    records = spark_sql(spark, sf, "SELECT *, 'https://P.example.com/' || CAST(l_partkey % 10 AS STRING) || '/?utm_source=m' AS source_url FROM {lineitem}", spread="lineitem")
    used = spark_sql(spark, sf, "SELECT l_orderkey, 'https://p.example.com/' || CAST(l_partkey % 10 AS STRING) AS url FROM {lineitem} WHERE l_returnflag = 'R'", spread="lineitem")
    return profiles.grounded_records(records, used, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
