"""Organization profiles: grounding in the pages that were really read, cleaning, gaps and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import once, phones, text as tx, url
from opporta.operators.dedup import distinct_values
from opporta.operators.responses import json_object
from opporta.schemas import PROFILE

# What a complete profile holds.
REQUIRED = ["industry", "size", "locations", "employee_count", "technologies", "projects", "contacts", "decision_makers"]
COLLECTIONS = ["projects", "news", "jobs", "tenders"]
CITED = COLLECTIONS + ["contacts", "evidence"]
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def grounded_records(records: DataFrame, pages_used: DataFrame, keys: list[str], source: str = "source_url") -> DataFrame:
    """Keep records whose source is one of the pages used for the same key. An equi semi join."""
    used = pages_used.select(*keys, url.canonical(F.col("url")).alias("_page")).where("_page <> ''")
    return records.withColumn("_page", url.canonical(F.col(source))).join(used, [*keys, "_page"], "left_semi").drop("_page")


def missing_fields(declared: Column, values: dict[str, Column]) -> Column:
    """Declared gaps, then required fields that are empty, without repeats."""
    def empty(value: Column, is_list: bool) -> Column:
        return F.coalesce(F.size(value) <= 0 if is_list else value == "", F.lit(True))
    lists = {"locations", "technologies", "projects", "contacts", "decision_makers"}
    found = F.array_compact(F.array(*[F.when(empty(values[f], f in lists), F.lit(f)) for f in REQUIRED]))
    return F.array_union(distinct_values(declared), found)


def _clean(value: Column) -> Column:
    return tx.blank_to_null(tx.squeeze(value))


def profiles(responses: DataFrame, pages_used: DataFrame) -> DataFrame:
    """Profile answers (doc_url, kind, body, name, official_url) to clean, grounded profiles.

    All cited records of an answer are exploded once, matched to the pages used by one semi join, and
    the surviving positions filter the arrays; a group is never larger than one answer.
    """
    kept_answers = responses.where("kind = 'profile'")
    opened = (
        once(kept_answers, kept_answers.columns, answer=F.xxhash64("doc_url", "body"), r=F.from_json(json_object(F.col("body")), PROFILE + ", _bad STRING", _OPTIONS))
        .withColumn("reject_reason", F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid profile")))
    good = opened.where("reject_reason IS NULL")
    def sources(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"r.{kind}.source_url"), F.array().cast("array<string>")),
                           lambda u, i: F.struct(F.concat(F.lit(kind + ":"), i.cast("string")).alias("slot"), u.alias("source_url")))

    cited = F.concat(*[sources(kind) for kind in CITED])
    proposed = F.array(F.struct(F.lit("official").alias("slot"), F.col("r.official_url").alias("source_url")))
    # Copies of an answer share its slots; different answers for one document do not mix.
    rows = good.select("doc_url", "answer", F.explode(F.concat(cited, proposed)).alias("c")).select("doc_url", "answer", "c.*")
    kept = grounded_records(rows.where("source_url IS NOT NULL"), pages_used, ["doc_url"]).groupBy("doc_url", "answer").agg(
        F.collect_set("slot").alias("slots"))
    joined = good.join(kept, ["doc_url", "answer"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<string>")))

    def grounded(kind: str) -> Column:
        return F.filter(F.col(f"r.{kind}"), lambda v, i: F.array_contains("slots", F.concat(F.lit(kind + ":"), i.cast("string"))))

    score = lambda c: F.when(c["decision_score"].rlike(r"^\s*[+-]?\d+(?:\.\d+)?\s*$"),
                             F.greatest(F.lit(0), F.least(F.lit(100), c["decision_score"].cast("double").cast("int"))))
    contacts = F.filter(F.transform(grounded("contacts"), lambda c: F.struct(
        _clean(c["full_name"]).alias("full_name"), _clean(c["raw_title"]).alias("raw_title"),
        F.coalesce(tx.blank_to_null(c["role_group"]), F.lit("other")).alias("role_group"), _clean(c["email"]).alias("email"),
        phones.normalize_phones(c["phone"]).alias("phone"), tx.blank_to_null(url.canonical(c["profile_url"])).alias("profile_url"),
        url.canonical(c["source_url"]).alias("source_url"), _clean(c["evidence_text"]).alias("evidence_text"),
        score(c).alias("decision_score"), _clean(c["decision_reason"]).alias("decision_reason"))),
        lambda c: c["evidence_text"].isNotNull())
    evidence = F.filter(F.transform(grounded("evidence"), lambda e: F.struct(
        F.left(_clean(e["field"]), F.lit(100)).alias("field"), e["value"].alias("value"),
        url.canonical(e["source_url"]).alias("source_url"), _clean(e["evidence_text"]).alias("evidence_text"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"))),
        lambda e: e["evidence_text"].isNotNull() & e["field"].isNotNull())
    official = F.coalesce(
        tx.blank_to_null(url.canonical(F.col("official_url"))),
        F.when(F.array_contains("slots", "official"), url.canonical(F.col("r.official_url"))))
    flat = joined.select(
        "doc_url", F.left(F.coalesce(_clean(F.col("r.legal_name")), F.col("name")), F.lit(300)).alias("legal_name"),
        official.alias("official_url"), *[_clean(F.col(f"r.{n}")).alias(n) for n in ("tax_code", "industry", "size", "employee_count")],
        F.col("r.revenue").alias("revenue"),
        *[F.coalesce(distinct_values(F.col(f"r.{n}")), F.array().cast("array<string>")).alias(n) for n in ("aliases", "locations", "technologies")],
        *[F.array_distinct(grounded(k)).alias(k) for k in COLLECTIONS], contacts.alias("contacts"), evidence.alias("evidence"),
        F.transform(F.coalesce("r.missing_information", F.array().cast("array<string>")), tx.squeeze).alias("declared"))
    values = {f: F.col(f) for f in REQUIRED if f != "decision_makers"}
    values["decision_makers"] = F.filter("contacts", lambda c: c["decision_score"].isNotNull())
    return flat.withColumn("domain", url.domain(F.col("official_url"))).withColumn(
        "missing_information", missing_fields(F.col("declared"), values)).drop("declared")


def rejected_profiles(responses: DataFrame) -> DataFrame:
    """Profile answers that gave no profile, with the reason."""
    read = responses.where("kind = 'profile'").withColumn("_r", F.from_json(json_object(F.col("body")), PROFILE + ", _bad STRING", _OPTIONS))
    return read.where(F.col("_r").isNull() | F.col("_r._bad").isNotNull()).select("doc_url", "body", F.lit("invalid profile").alias("reject_reason"))


def profile_status(missing: Column, crawl_error: Column, extraction_error: Column, supplemental_error: Column) -> Column:
    return (F.when(F.size(missing) == 0, "COMPLETE")
            .when(crawl_error.isNotNull() & supplemental_error.isNotNull(), "SECOND_CRAWL_BLOCKED")
            .when(extraction_error.isNotNull() & supplemental_error.isNotNull(), "AI_EXTRACTION_FAILED")
            .otherwise("PROFILE_INCOMPLETE"))


def enrichment_plan(extracted: DataFrame) -> DataFrame:
    """What to do for each organization: read its own site, search for it, or nothing."""
    from opporta.functions import addresses
    named = tx.blank_to_null(tx.squeeze(F.col("organization_name"))).isNotNull()
    site = url.canonical(F.col("organization_website"))
    staged = extracted.withColumn("_site", tx.blank_to_null(site))
    usable = F.col("_site").isNotNull() & ~addresses.is_search_engine(F.col("_site")) & addresses.url_problem(F.col("_site")).isNull()
    return staged.withColumn("enrichment", F.when(~named, "ORGANIZATION_NOT_IDENTIFIED").when(F.coalesce(usable, F.lit(False)), "SITE").otherwise("SEARCH")).withColumn(
        "official_url", F.when(F.col("enrichment") == "SITE", url.root(F.col("_site")))).drop("_site")
