"""Derived inputs. Plain SELECT text that both engines read the same way."""

from opporta.catalog import VIEWS

VIEWS["v_leads"] = """
SELECT CAST(o_orderkey AS STRING) AS id, 'src_' || CAST(o_custkey % 12 AS STRING) AS source,
 'https://src' || CAST(o_custkey % 12 AS STRING) || '.example.com/lead/' || CAST(o_orderkey AS STRING) AS source_url,
 'Order ' || o_orderpriority || ' of ' || c_name AS title, c_name AS organization_name,
 CASE o_orderstatus WHEN 'F' THEN 'government' WHEN 'O' THEN 'enterprise' ELSE 'other' END AS organization_type,
 CASE WHEN o_orderkey % 13 = 0 THEN '[Hàng đợi AI] ' ELSE '' END || 'Need ' || c_mktsegment || ' in ' || n_name AS need_summary,
 c_mktsegment || '|' || o_orderpriority AS categories,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE o_totalprice END AS budget_value,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' VND' END AS budget_text,
 n_name AS location, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Contact ' || CAST(o_custkey AS STRING) END AS contact_name,
 CASE WHEN c_acctbal > 0 THEN 'c' || CAST(o_custkey AS STRING) || '@example.com' END AS contact_email,
 CASE WHEN c_acctbal > 5000 THEN '09' || lpad(CAST(o_custkey AS STRING), 8, '0') END AS contact_phone,
 CAST(o_orderdate AS {TS}) AS published_at, CAST(o_orderdate AS {TS}) + INTERVAL '1' DAY AS crawled_at,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS {TS}) + INTERVAL '30' DAY END AS deadline,
 CAST(o_orderkey % 101 AS INT) AS score, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS relevance,
 CASE WHEN o_orderkey % 101 >= 90 THEN 'CALL' WHEN o_orderkey % 101 >= 80 THEN 'EMAIL' ELSE 'NURTURE' END AS recommended_action,
 CASE WHEN o_orderkey % 7 = 0 THEN 'ARCHIVED' WHEN o_orderkey % 11 = 0 THEN 'PENDING_AI' ELSE 'NEW' END AS status,
 CAST(o_custkey AS STRING) AS organization_id, o_orderkey AS position
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

VIEWS["v_raw"] = """
SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS source_id, html,
 CAST(DATE '2026-01-01' + CAST(page_id % 30 AS INT) AS {TS}) AS fetched_at,
 CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status_code,
 CASE WHEN page_id % 11 = 4 THEN 'application/pdf' WHEN page_id % 11 = 5 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
 CASE WHEN page_id % 13 = 5 THEN '<p>Just a Moment...</p>' || html WHEN page_id % 17 = 6 THEN ' ' ELSE html END AS body
FROM {pages}"""

VIEWS["v_url_feed"] = """
SELECT page_id, variant, url FROM (
 SELECT page_id, 0 AS variant, url FROM {pages}
 UNION ALL SELECT page_id, 1 AS variant, url || '#frag' AS url FROM {pages}
 UNION ALL SELECT page_id, 2 AS variant, regexp_extract(url, '^([^#]*)', 1)
  || CASE WHEN position('?' IN url) > 0 THEN '&fbclid=1' ELSE '?fbclid=1' END || regexp_extract(url, '(#.*)$', 1) AS url FROM {pages}
 UNION ALL SELECT page_id, 3 AS variant, regexp_extract(url, '^([a-z]+://)', 1) || upper(regexp_extract(url, '://([^/]*)', 1))
  || regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS url FROM {pages}) AS feed"""

VIEWS["v_orders_text"] = """
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice, CAST(o_orderdate AS {TS}) AS o_orderdate,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_iso,
 substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2)
  || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS day_vn
FROM {orders}"""

VIEWS["v_articles"] = """
SELECT o_orderkey, 'https://news.example.com/a/' || CAST(o_orderkey AS STRING) AS url, 'generic' AS source_id, o_orderdate AS fetched_at,
 '<html><head><title>T</title>' ||
 CASE o_orderpriority WHEN '1-URGENT' THEN '<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"' || day_iso || '"}</script>'
  WHEN '2-HIGH' THEN '<meta property="article:modified_time" content="2030-01-01T00:00:00"><meta property="article:published_time" content="' || day_iso || 'T07:30:00+07:00">'
  ELSE '' END || '</head><body><h1>Tin ' || CAST(o_orderkey AS STRING) || ' ngày ' || day_vn || '</h1>' ||
 CASE o_orderpriority WHEN '3-MEDIUM' THEN '<p>Ngày đăng: ' || day_vn || ' 08:15</p><time>01/01/2030</time>'
  WHEN '4-NOT SPECIFIED' THEN '<span class="post-date">' || day_vn || '</span>'
  ELSE '<p class="date">Hạn chót: ' || day_vn || '</p>' END || '</body></html>' AS html
FROM {v_orders_text}"""

VIEWS["v_outcomes"] = """
SELECT event_id, 'src_' || CAST(user_id % 12 AS STRING) AS source, CAST(ts AS DATE) AS run_day, CAST(ts AS {TS}) AS ts,
 CASE event_type WHEN 'view' THEN 'NEW' WHEN 'click' THEN 'DUPLICATE' WHEN 'signup' THEN 'FILTERED_KEYWORD'
  WHEN 'purchase' THEN 'FILTERED_SCORE' ELSE 'ERROR' END AS outcome
FROM {events}"""

VIEWS["v_runs"] = """
SELECT source || '@' || CAST(run_day AS STRING) AS id, source, CAST(run_day AS STRING) AS job_id, min(ts) AS start_time, max(ts) AS end_time,
 CASE WHEN run_day = DATE '2024-01-30' THEN 'RUNNING' WHEN sum(CASE WHEN outcome = 'ERROR' THEN 1 ELSE 0 END) = 0 THEN 'SUCCESS'
  WHEN sum(CASE WHEN outcome = 'ERROR' THEN 1 ELSE 0 END) * 3 > count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS status,
 count(*) AS total_discovered, sum(CASE WHEN outcome = 'NEW' THEN 1 ELSE 0 END) AS new_leads,
 sum(CASE WHEN outcome = 'DUPLICATE' THEN 1 ELSE 0 END) AS duplicate_leads,
 sum(CASE WHEN outcome LIKE 'FILTERED%' THEN 1 ELSE 0 END) AS filtered_out,
 sum(CASE WHEN outcome = 'ERROR' THEN 1 ELSE 0 END) AS error_count, CAST(NULL AS STRING) AS error_message
FROM {v_outcomes} GROUP BY source, run_day"""

VIEWS["v_jobs"] = """
SELECT CAST(o_orderkey AS STRING) AS id,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'src_' || CAST(o_custkey % 12 AS STRING) END AS source_id,
 CASE o_orderpriority WHEN '2-HIGH' THEN 'SCHEDULE' WHEN '3-MEDIUM' THEN 'CLI' WHEN '5-LOW' THEN 'OTHER' ELSE 'FE' END AS trigger,
 CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'FAILED' WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'PARTIAL'
  WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderpriority = '3-MEDIUM' THEN 'PAUSED'
  WHEN o_orderpriority = '5-LOW' THEN 'INTERRUPTED' ELSE 'RUNNING' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN '1_day' WHEN '2-HIGH' THEN '1_week' ELSE '1_month' END AS timeframe,
 CAST(o_orderdate AS {TS}) AS requested_at, CAST(o_orderdate AS {TS}) + INTERVAL '1' HOUR AS started_at,
 CAST(o_orderdate AS {TS}) + INTERVAL '2' HOUR AS completed_at, CAST('w' AS STRING) AS worker_id, CAST(NULL AS STRING) AS error_message,
 CASE WHEN o_orderkey % 4 = 0 THEN '{"new_leads":' || CAST(o_orderkey AS STRING) || '}' WHEN o_orderkey % 4 = 1 THEN '[1,2]'
  WHEN o_orderkey % 4 = 2 THEN '{broken' END AS result_json
FROM {orders}"""

VIEWS["v_sources"] = """
SELECT 'src_' || CAST(s_suppkey AS STRING) AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'generic' ELSE 'specialized' END AS adapter_mode,
 CASE s_suppkey % 5 WHEN 0 THEN 'chinhphu' WHEN 1 THEN 'vnexpress' WHEN 2 THEN 'topcv' WHEN 3 THEN 'unknown' ELSE '' END AS adapter_key,
 s_acctbal > 0 AS enabled, s_nationkey % 2 = 0 AS include_in_schedule, 'READY' AS status,
 'https://s' || CAST(s_suppkey AS STRING) || '.example.com/' AS seed_url, '' AS last_error
FROM {supplier}"""

VIEWS["v_contacts"] = """
SELECT CAST(l_suppkey AS STRING) AS organization_id, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS position,
 'P' || CAST(l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS STRING) AS full_name,
 CASE WHEN (l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) % 3 = 0 THEN NULL
  ELSE 'p' || CAST(l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS STRING) || '@example.com' END AS email,
 CASE WHEN (l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) % 5 = 0 THEN ''
  ELSE '09' || lpad(CAST((l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) % 100000000 AS STRING), 8, '0') END AS phone,
 CASE WHEN (l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) % 4 = 0 THEN NULL
  ELSE CAST((l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) % 101 AS INT) END AS decision_score
FROM {lineitem}"""

VIEWS["v_sites"] = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS site_no, c_custkey AS page_no, c_acctbal, c_name, c_mktsegment,
 'https://site' || CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS STRING) || '.example.com/p' || CAST(c_custkey AS STRING) AS url
FROM {customer}"""

VIEWS["v_site_edges"] = """
SELECT a.site_no, a.page_no AS src, b.page_no AS dst, a.url AS src_url, b.url AS dst_url, b.page_no AS position FROM (
 SELECT site_no, page_no, page_no + 1 AS next_no, url FROM {v_sites} UNION ALL SELECT site_no, page_no, page_no + 7 AS next_no, url FROM {v_sites}
 UNION ALL SELECT site_no, page_no, page_no + 16 AS next_no, url FROM {v_sites} UNION ALL SELECT site_no, page_no, page_no + 55 AS next_no, url FROM {v_sites}) AS a
JOIN {v_sites} AS b ON a.next_no = b.page_no AND a.site_no = b.site_no"""

VIEWS["v_mentions"] = """
SELECT 'c' || CAST(c_custkey AS STRING) AS mention_id, CASE WHEN c_custkey % 12 = 0 THEN 'Firm ' || CAST(c_nationkey AS STRING) ELSE 'Firm ' || CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING) END AS legal_name,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'd' || CAST(CAST(floor(c_custkey / 7) AS BIGINT) AS STRING) || '.com' END AS domain,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 't' || CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING) END AS tax_code,
 CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS industry, CAST(DATE '2026-01-01' + CAST(c_custkey % 300 AS INT) AS {TS}) AS verified_at
FROM {customer}
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING) AS mention_id, s_name AS legal_name, 'd' || CAST(s_suppkey * 2 AS STRING) || '.com' AS domain, CAST(NULL AS STRING) AS tax_code,
 CAST(NULL AS STRING) AS industry, CAST(DATE '2026-06-01' + CAST(s_nationkey AS INT) AS {TS}) AS verified_at
FROM {supplier}"""
