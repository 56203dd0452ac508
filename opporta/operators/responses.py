"""Recorded model answers to validated rows; what fails validation goes to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import once, phones, text as tx, url
from opporta.schemas import ACTIONS, ORGANIZATION_TYPES

# Answers are read with text for every scalar, so that `"85"` and `85` both count.
_EXTRACTION = """organization_name STRING, organization_type STRING, organization_website STRING,
 organization_tax_code STRING, need_summary STRING, need_categories ARRAY<STRING>, budget_value STRING,
 budget_text STRING, location STRING, contact_name STRING, contact_email STRING, contact_phone STRING,
 deadline STRING, relevance STRING, evidence ARRAY<STRING>, confidence STRING, web_search_used STRING,
 search_sources ARRAY<STRING>, missing_information ARRAY<STRING>, _bad STRING"""
_SCORE = """total_score STRING, recommended_action STRING, score_reasons ARRAY<STRING>,
 breakdown ARRAY<STRUCT<rule_name: STRING, points: STRING, reason: STRING>>, sales_strategy_suggestion STRING, _bad STRING"""
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def json_object(body: Column) -> Column:
    """Outermost `{...}` of an answer, without code fences; null when there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(body), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def _opened(responses: DataFrame, kind: str, ddl: str) -> DataFrame:
    """Answers of one kind with their parsed record `r` and a first `reject_reason`."""
    doc = F.col("_doc")
    kept = responses.where(F.col("kind") == kind)
    read = once(kept, kept.columns, _doc=json_object(F.col("body")))
    return once(
        read, kept.columns, r=F.from_json(doc, ddl, _OPTIONS),
        broken=F.when(doc.isNull(), "no JSON object").when(F.try_parse_json(doc).isNull(), "invalid JSON")).withColumn(
        "reject_reason", F.coalesce("broken", F.when(F.col("r._bad").isNotNull(), "invalid field"))).drop("broken")


def _bad_number(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNull()


def extractions(responses: DataFrame) -> DataFrame:
    """Extraction answers (doc_url, kind, body): typed columns and `reject_reason`."""
    opened = _opened(responses, "extraction", _EXTRACTION)
    website = F.trim(F.coalesce(F.col("r.organization_website"), F.lit("")))
    kind = F.lower(F.trim("r.organization_type"))
    empty = F.array().cast("array<string>")
    listed = {n: F.coalesce(F.col(f"r.{n}"), empty) for n in ("need_categories", "evidence", "search_sources", "missing_information")}
    numbers = {"budget_value": None, "relevance": 0.0, "confidence": 0.0}
    reason = F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
    for n in numbers:
        reason = reason.when(_bad_number(F.col(f"r.{n}")), F.lit(f"invalid {n}"))
    return opened.select(
        "doc_url", "body", reason.alias("reject_reason"),
        *[F.col(f"r.{n}").alias(n) for n in ("organization_name", "organization_tax_code", "need_summary", "budget_text",
                                            "location", "contact_name", "contact_email", "deadline")],
        F.when(kind.isin(*ORGANIZATION_TYPES), kind).alias("organization_type"),
        F.when(website == "", None).when(website.contains("://"), website).otherwise(
            F.concat(F.lit("https://"), website)).alias("organization_website"),
        phones.normalize_phones(F.col("r.contact_phone")).alias("contact_phone"),
        *[F.coalesce(F.col(f"r.{n}").try_cast("double"), F.lit(d).cast("double")).alias(n) for n, d in numbers.items()],
        F.coalesce(F.col("r.web_search_used").try_cast("boolean"), F.lit(False)).alias("web_search_used"),
        *[v.alias(n) for n, v in listed.items()])


def grounded_website(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """Null the website unless its host stands in the source text.

    Only rows with a website ask for their text, in an inner join of its own, which lets Spark drop the texts that nobody
    asks for at their scan (runtime Bloom filter) before any text moves. What comes back is one short row for each website found.
    """
    site = F.col("organization_website")
    # Its own test stays a plain one: the runtime filter takes no pattern.
    asked = extracted.where("organization_website <> ''").select(F.col("doc_url").alias("_u"), site.alias("_site"), F.regexp_replace(url.host(site), r"^www\.", "").alias("_host"))
    texts = documents.select(F.col("doc_url").alias("_u"), F.col("raw_content").alias("_text"))
    stands = F.coalesce((F.col("_host") != "") & F.contains(F.lower("_text"), F.col("_host")), F.lit(False))
    found = asked.join(texts, "_u").where(stands).select("_u", "_site", F.lit(True).alias("_found")).distinct()
    joined = extracted.join(found, (extracted["doc_url"] == found["_u"]) & (extracted["organization_website"] == found["_site"]), "left")
    return joined.withColumn("organization_website", F.when(F.col("_found"), site)).drop("_u", "_site", "_found")


def scores(responses: DataFrame, evaluated_by: str) -> DataFrame:
    """Score answers: clamped total, one of three actions or rejected, breakdown rows."""
    opened = _opened(responses, "score", _SCORE)
    action = F.upper(F.trim("r.recommended_action"))
    total = F.coalesce(F.col("r.total_score"), F.lit("0"))
    # Text must be a whole number; a JSON number loses its fraction. Both look alike here.
    value = F.when(total.rlike(r"^\s*[+-]?\d+\s*$"), total.try_cast("bigint")).otherwise(
        F.when(total.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), total.try_cast("double").cast("bigint")))
    reason = (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
              .when(value.isNull(), "invalid total_score")
              .when(F.coalesce(~action.isin(*ACTIONS), F.lit(True)), "invalid recommended_action"))
    parts = F.transform(F.col("r.breakdown"), lambda b: F.struct(
        F.coalesce(b["rule_name"], F.lit("rule")).alias("rule_name"),
        F.coalesce(b["points"].try_cast("double").cast("int"), F.lit(0)).alias("points"),
        F.coalesce(b["reason"], F.lit("")).alias("reason")))
    return opened.select(
        "doc_url", "body", reason.alias("reject_reason"),
        F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("int").alias("total_score"),
        action.alias("recommended_action"), F.coalesce("r.score_reasons", F.array().cast("array<string>")).alias("score_reasons"),
        F.coalesce(parts, F.array().cast("array<struct<rule_name:string,points:int,reason:string>>")).alias("breakdown"),
        F.col("r.sales_strategy_suggestion").alias("sales_strategy"), F.lit(evaluated_by).alias("evaluated_by"))


def accepted(answers: DataFrame) -> DataFrame:
    return answers.where("reject_reason IS NULL").drop("reject_reason", "body")


def rejected(answers: DataFrame, kind: str) -> DataFrame:
    return answers.where("reject_reason IS NOT NULL").select("doc_url", F.lit(kind).alias("kind"), "body", "reject_reason")


def search_queries(responses: DataFrame) -> DataFrame:
    """Search-query answers: the first usable query, at most 500 characters."""
    listed = F.from_json(F.get_json_object(json_object(F.col("body")), "$.queries"), "ARRAY<STRING>")
    opened = responses.where("kind = 'query'").select("doc_url", F.posexplode(listed).alias("pos", "q")).select(
        "doc_url", "pos", F.left(tx.normalize(F.col("q")), F.lit(500)).alias("query")).where("query <> ''")
    return opened.groupBy("doc_url").agg(F.min_by("query", "pos").alias("query"))
