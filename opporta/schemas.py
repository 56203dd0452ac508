"""Table schemas (DDL) and closed value lists. Times are wall clock without a zone."""

RAW_DOCUMENTS = """url STRING, source_id STRING, fetched_at TIMESTAMP_NTZ, html STRING, text STRING,
 headers MAP<STRING,STRING>, status_code INT, snapshot_path STRING"""

PARSED_ITEMS = """url STRING, source_id STRING, title STRING, raw_content STRING,
 published_at TIMESTAMP_NTZ, author STRING, error STRING"""

KEYWORDS = """keyword STRING, group_id STRING, group_name STRING, use_for_filter BOOLEAN,
 use_for_discovery BOOLEAN, active BOOLEAN"""

LEADS = """id STRING, source STRING, source_url STRING, title STRING, published_at TIMESTAMP_NTZ,
 crawled_at TIMESTAMP_NTZ, organization_name STRING, organization_type STRING, need_summary STRING,
 need_categories ARRAY<STRING>, budget_value DOUBLE, budget_text STRING, location STRING,
 contact_name STRING, contact_email STRING, contact_phone STRING, deadline TIMESTAMP_NTZ,
 keywords_matched ARRAY<STRING>, relevance DOUBLE, score INT, recommended_action STRING,
 score_reasons ARRAY<STRING>, evidence ARRAY<STRING>, raw_content_ref STRING,
 content_fingerprint STRING, sales_strategy STRING, status STRING, sales_notes STRING,
 organization_id STRING, enrichment_status STRING, enrichment_message STRING,
 updated_at TIMESTAMP_NTZ"""

# Column order of the lead sheet.
LEAD_SHEET = [
    "id", "source", "source_url", "title", "published_at", "crawled_at",
    "organization_name", "organization_type", "need_summary", "need_categories",
    "budget_value", "budget_text", "location", "contact_name", "contact_email",
    "contact_phone", "deadline", "keywords_matched", "relevance", "score",
    "recommended_action", "score_reasons", "evidence", "sales_strategy",
    "content_fingerprint", "status", "sales_notes", "updated_at",
    "organization_id", "enrichment_status", "enrichment_message",
]
LEAD_SHEET_LISTS = ("need_categories", "keywords_matched", "score_reasons", "evidence")
LEAD_SHEET_DATES = ("published_at", "crawled_at", "deadline", "updated_at")

PROJECT = "STRUCT<name: STRING, summary: STRING, source_url: STRING>"
NEWS = "STRUCT<title: STRING, published_at: STRING, source_url: STRING>"
TITLED = "STRUCT<title: STRING, source_url: STRING>"

ORGANIZATIONS = f"""id STRING, legal_name STRING, aliases ARRAY<STRING>, official_url STRING,
 domain STRING, tax_code STRING, organization_type STRING, industry STRING, size STRING,
 locations ARRAY<STRING>, revenue STRING, employee_count STRING, technologies ARRAY<STRING>,
 projects ARRAY<{PROJECT}>, news ARRAY<{NEWS}>, jobs ARRAY<{TITLED}>, tenders ARRAY<{TITLED}>,
 profile_status STRING, missing_information ARRAY<STRING>, verification_confidence DOUBLE,
 search_used BOOLEAN, source_urls ARRAY<STRING>, error_message STRING, verified_at TIMESTAMP_NTZ,
 updated_at TIMESTAMP_NTZ"""

CONTACTS = """id STRING, organization_id STRING, full_name STRING, raw_title STRING,
 role_group STRING, email STRING, phone STRING, profile_url STRING, source_url STRING,
 evidence_text STRING, decision_score INT, decision_reason STRING, verified_at TIMESTAMP_NTZ"""

EVIDENCE = """id STRING, organization_id STRING, field STRING, value STRING, source_url STRING,
 evidence_text STRING, crawled_at TIMESTAMP_NTZ, confidence DOUBLE"""

CRAWL_RUNS = """id STRING, source STRING, status STRING, start_time TIMESTAMP_NTZ,
 end_time TIMESTAMP_NTZ, total_discovered INT, new_leads INT, duplicate_leads INT,
 filtered_out INT, error_count INT, error_message STRING"""

CRAWL_JOBS = """id STRING, source_id STRING, trigger STRING, status STRING, timeframe STRING,
 force_recrawl BOOLEAN, requested_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ,
 completed_at TIMESTAMP_NTZ, worker_id STRING, result_json STRING, error_message STRING,
 dedupe_key STRING"""

SOURCES = """id STRING, name STRING, description STRING, seed_urls ARRAY<STRING>,
 adapter_mode STRING, adapter_key STRING, crawl_scope STRING, rate_limit_delay DOUBLE, timeout INT,
 enabled BOOLEAN, include_in_schedule BOOLEAN, status STRING, last_error STRING,
 last_attempt_at STRING, last_success_at STRING, created_at STRING, updated_at STRING"""

# What a model is asked to return for one document.
EXTRACTION = """organization_name STRING, organization_type STRING, organization_website STRING,
 organization_tax_code STRING, need_summary STRING, need_categories ARRAY<STRING>,
 budget_value DOUBLE, budget_text STRING, location STRING, contact_name STRING,
 contact_email STRING, contact_phone STRING, deadline STRING, relevance DOUBLE,
 evidence ARRAY<STRING>, confidence DOUBLE, web_search_used BOOLEAN,
 search_sources ARRAY<STRING>, missing_information ARRAY<STRING>"""

SCORE = """total_score DOUBLE, recommended_action STRING, score_reasons ARRAY<STRING>,
 breakdown ARRAY<STRUCT<rule_name: STRING, points: DOUBLE, reason: STRING>>,
 sales_strategy_suggestion STRING"""

PROFILE = f"""legal_name STRING, aliases ARRAY<STRING>, official_url STRING, tax_code STRING,
 industry STRING, size STRING, locations ARRAY<STRING>, revenue STRING, employee_count STRING,
 technologies ARRAY<STRING>, projects ARRAY<{PROJECT}>, news ARRAY<{NEWS}>,
 jobs ARRAY<{TITLED}>, tenders ARRAY<{TITLED}>,
 contacts ARRAY<STRUCT<full_name: STRING, raw_title: STRING, role_group: STRING, email: STRING,
  phone: STRING, profile_url: STRING, source_url: STRING, evidence_text: STRING,
  decision_score: STRING, decision_reason: STRING>>,
 evidence ARRAY<STRUCT<field: STRING, value: STRING, source_url: STRING, evidence_text: STRING,
  confidence: STRING>>,
 missing_information ARRAY<STRING>"""

# Fixed values.
ACTIONS = ("CALL", "EMAIL", "NURTURE")
LEAD_STATUSES = ("NEW", "PENDING_AI", "CONTACTED", "QUALIFIED", "DISMISSED", "ARCHIVED")
ORGANIZATION_TYPES = ("government", "enterprise", "other")
RUN_STATUSES = ("IDLE", "RUNNING", "SUCCESS", "PARTIAL", "FAILED", "INTERRUPTED")
SCORE_THRESHOLD = 40
