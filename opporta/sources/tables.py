"""Flat files: exports, sheet rows out and in, collections of organizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.functions import dates, ids, phones, text as tx, url
from opporta.operators.leads import is_processed
from opporta.schemas import (CONTACTS, EVIDENCE, LEAD_SHEET, LEAD_SHEET_DATES, LEAD_SHEET_LISTS, NEWS, PROJECT, SCORE_THRESHOLD, TITLED)

# Header labels of the CSV export, with the column behind each.
CSV_COLUMNS = [
    ("Lead ID", "id"), ("Điểm số (Score)", "score"), ("Hành động đề xuất (Action)", "recommended_action"),
    ("Đơn vị / Cơ quan (Organization)", "organization_name"), ("Nhu cầu trọng tâm (Need Summary)", "need_summary"),
    ("Phân loại (Categories)", "need_categories"), ("Ngân sách (Budget VND)", "budget_value"), ("Ngân sách text", "budget_text"),
    ("Địa bàn (Location)", "location"), ("Nguồn (Source)", "source"), ("Link nguồn (Source URL)", "source_url"),
    ("Ngày đăng (Published Date)", "published_at"), ("Ngày crawl (Crawled Date)", "crawled_at"), ("Người liên hệ", "contact_name"),
    ("Email", "contact_email"), ("Số điện thoại", "contact_phone"), ("Lý do chấm điểm (Score Reasons)", "score_reasons"),
]
JSON_COLUMNS = [
    "id", "score", "recommended_action", "organization_name", "organization_type", "need_summary", "need_categories", "budget_value",
    "budget_text", "location", "source", "source_url", "published_at", "crawled_at", "contact_name", "contact_email", "contact_phone",
    "deadline", "relevance", "score_reasons", "evidence", "status",
]
COLLECTION_KINDS = ("projects", "news", "jobs", "tenders")
BOM = "﻿"
FILE_ROWS = 100_000


def best_first(leads: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = leads.orderBy(F.col("score").desc_nulls_last(), F.col("crawled_at").desc_nulls_last(), "id")
    return ordered if limit is None else ordered.limit(limit)


def _shown(name: str) -> Column:
    """CSV cell text: joined lists, `dd/MM/yyyy HH:mm`, nothing for null and for a zero budget."""
    col = F.col(name)
    if name == "need_categories":
        col = F.array_join(col, ", ")
    elif name == "score_reasons":
        col = F.array_join(col, " | ")
    elif name in ("published_at", "crawled_at"):
        col = F.date_format(col, "dd/MM/yyyy HH:mm")
    elif name == "budget_value":
        # Plain digits with at least one decimal, as a stored float prints.
        fixed = F.regexp_replace(F.translate(F.format_number(col, 6), ",", ""), r"0+$", "")
        col = F.when(col != 0, F.regexp_replace(fixed, r"\.$", ".0"))
    return F.coalesce(col.cast("string"), F.lit(""))


def csv_rows(leads: DataFrame, labelled: bool = True) -> DataFrame:
    """The 17 export columns as text, under their display labels or their plain names."""
    return leads.select(*[_shown(c).alias(label if labelled else c) for label, c in CSV_COLUMNS])


def write_csv(leads: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV for spreadsheets: one byte-order mark, before the first label. The best `limit`
    rows are one file; without a limit the whole table is written in parts."""
    rows = csv_rows(best_first(leads, limit) if limit else leads)
    first, *rest = rows.columns
    marked = rows.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in rest])
    (marked.coalesce(1) if limit else marked).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path)


def iso(ts: Column) -> Column:
    """`2026-08-24T09:30:00`, with six decimals only when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def json_rows(leads: DataFrame) -> DataFrame:
    return leads.select(*[iso(F.col(c)).alias(c) if c in LEAD_SHEET_DATES else F.col(c) for c in JSON_COLUMNS])


def write_json(leads: DataFrame, path: str, limit: int | None = None) -> None:
    json_rows(best_first(leads, limit) if limit else leads).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def lead_sheet_rows(leads: DataFrame) -> DataFrame:
    """Leads as text cells in sheet order: lists as JSON, ISO times, empty text for null."""
    def cell(name: str) -> Column:
        col = F.col(name)
        if name == "contact_phone":
            col = phones.normalize_phones(col)
        elif name == "source_url":
            col = url.canonical(col)
        elif name in LEAD_SHEET_LISTS:
            col = F.to_json(col)
        elif name in LEAD_SHEET_DATES:
            col = iso(col)
        return F.coalesce(col.cast("string"), F.lit("")).alias(name)
    return leads.select(*[cell(c) for c in LEAD_SHEET])


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Any table as text cells in the given order: lists and objects as JSON, ISO times, empty text for null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def cell(name: str) -> Column:
        col = F.col(name)
        if kinds[name] in ("array", "struct", "map"):
            col = F.to_json(col)
        elif kinds[name].startswith("timestamp"):
            col = iso(col)
        return F.coalesce(col.cast("string"), F.lit("")).alias(name)
    return df.select(*[cell(c) for c in columns])


def names_of(ddl: str) -> list[str]:
    """Column names of one of the DDL schemas whose columns are plain."""
    return [c.split()[0] for c in ddl.replace("\n", " ").split(",")]


def write_sheet(rows: DataFrame, path: str) -> None:
    """Text cells as CSV files that `read_sheet` takes back unchanged: every cell quoted, a byte-order mark before the first header.

    A file with line ends in its cells is read by one task, so a file holds `FILE_ROWS` rows at most.
    """
    first, *rest = rows.columns
    rows.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in rest]).write.mode("overwrite").options(
        header=True, maxRecordsPerFile=FILE_ROWS, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text cells of a CSV sheet, which may hold line ends and quotes. The header must be exactly the expected one. An empty cell is null."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    found = [c.removeprefix(BOM) for c in rows.columns]
    if found != columns:
        raise ValueError(f"sheet header does not match: {found}")
    return rows.toDF(*columns)


def leads_from_sheet(sheet: DataFrame, stored: DataFrame, now: Column, position: str = "position") -> DataFrame:
    """Typed leads from text cells: bad cells become defaults, unprocessed, low and known rows are skipped.

    The first row of a page (canonical URL) decides, even when it is then skipped for its score.
    """
    def blank(name: str) -> Column:
        return tx.blank_to_null(F.col(name))
    usable = sheet.where(is_processed(F.col("status"), F.col("need_summary"))).withColumn("source_url", url.canonical(F.trim(F.coalesce("source_url", F.lit("")))))
    cells = [c for c in LEAD_SHEET if c != "source_url"]
    first = usable.where("source_url <> ''").groupBy("source_url").agg(F.min_by(F.struct(*cells), position).alias("s")).select("source_url", "s.*")
    fresh = first.join(stored.select("source_url"), "source_url", "left_anti")
    empty = F.array().cast("array<string>")
    defaults = {"source": "google_sheets", "title": "Không có tiêu đề", "status": "NEW", "recommended_action": "NURTURE"}
    typed = []
    for name in LEAD_SHEET:
        col = blank(name)
        if name in LEAD_SHEET_LISTS:
            col = F.coalesce(F.from_json(F.when(F.try_parse_json(col).isNotNull(), col), "ARRAY<STRING>"), empty)
        elif name in LEAD_SHEET_DATES:
            col = dates.iso_or_null(col)
        elif name == "score":
            col = col.try_cast("double").cast("int")
        elif name in ("budget_value", "relevance"):
            col = col.try_cast("double")
        elif name == "contact_phone":
            col = phones.normalize_phones(col)
        if name in defaults:
            col = F.coalesce(col, F.lit(defaults[name]))
        typed.append(col.alias(name))
    rows = fresh.select(*typed).where(F.coalesce("score", F.lit(0)) >= SCORE_THRESHOLD)
    return rows.withColumns({"crawled_at": F.coalesce("crawled_at", now), "id": F.coalesce("id", ids.lead_id(F.col("source_url")))})


def collection_rows(organizations: DataFrame) -> DataFrame:
    """One flat row per project, news item, job and tender; equal ids collapse to the last one."""
    none = F.lit(None).cast("string")
    parts = None
    for kind in COLLECTION_KINDS:
        item = F.posexplode(kind).alias("pos", "v")
        one = organizations.select("id", "updated_at", item).select(
            F.col("id").alias("organization_id"), F.lit(kind).alias("kind"), "pos",
            (F.coalesce(tx.blank_to_null(F.col("v.name")), F.lit(None).cast("string")) if kind == "projects" else F.col("v.title")).alias("title"),
            (F.col("v.summary") if kind == "projects" else none).alias("summary"),
            (F.col("v.published_at") if kind == "news" else none).alias("published_at"), F.col("v.source_url").alias("source_url"),
            F.to_json("v").alias("payload"), "updated_at")
        parts = one if parts is None else parts.unionByName(one)
    keyed = parts.withColumn("id", ids.keyed_id(F.col("organization_id"), F.col("kind"), F.col("source_url"), F.col("title")))
    rest = [c for c in keyed.columns if c != "id"]
    return keyed.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("organization_id", "pos")).alias("r")).select("id", "r.*").drop("pos")


def restore_organizations(cells: DataFrame, search_used: str = "search_used") -> DataFrame:
    """Organizations from text cells; rows without id or name are dropped. `search_used` is the sheet's header
    of the column that tells whether a search service was asked."""
    empty = F.array().cast("array<string>")
    lists = ("aliases", "locations", "technologies", "missing_information", "source_urls")
    plain = ("official_url", "domain", "tax_code", "organization_type", "industry", "size", "employee_count", "profile_status", "error_message")
    has = [c for c in cells.columns]
    out = [F.trim("id").alias("id"), F.trim("legal_name").alias("legal_name")]
    out += [tx.blank_to_null(F.col(c)).alias(c) for c in plain if c in has]
    out += [F.coalesce(F.from_json(F.when(F.try_parse_json(c).isNotNull(), F.col(c)), "ARRAY<STRING>"), empty).alias(c) for c in lists if c in has]
    if "verification_confidence" in has:
        out.append(F.coalesce(F.col("verification_confidence").try_cast("double"), F.lit(0.0)).alias("verification_confidence"))
    if search_used in has:
        out.append(F.lower(F.coalesce(search_used, F.lit(""))).isin("1", "true", "yes").alias("search_used"))
    out += [dates.iso_or_null(F.col(c)).alias(c) for c in ("verified_at", "updated_at") if c in has]
    return cells.select(*out).where("id <> '' AND legal_name <> ''")


def restore_contacts(cells: DataFrame, organizations: DataFrame) -> DataFrame:
    """Contacts whose organization exists."""
    kept = cells.where("trim(id) <> '' AND trim(organization_id) <> ''").withColumn("organization_id", F.trim("organization_id")).join(
        organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_semi")
    score = F.coalesce("decision_score", F.lit("")).try_cast("double").cast("int")
    return kept.withColumns({"phone": phones.normalize_phones(F.col("phone")), "decision_score": score, "verified_at": dates.iso_or_null(F.col("verified_at"))}).select(
        *[c.split()[0] for c in CONTACTS.replace("\n", " ").split(",")])


def restore_evidence(cells: DataFrame, organizations: DataFrame, now: Column) -> DataFrame:
    kept = cells.where("trim(id) <> '' AND field <> '' AND source_url <> ''").withColumn("organization_id", F.trim("organization_id")).join(
        organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_semi")
    return kept.withColumns({
        "crawled_at": F.coalesce(dates.iso_or_null(F.col("crawled_at")), now), "evidence_text": F.coalesce("evidence_text", F.lit("")),
        "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))}).select(*[c.split()[0] for c in EVIDENCE.replace("\n", " ").split(",")])


def restored_payloads(cells: DataFrame, organizations: DataFrame) -> DataFrame:
    """Collection rows of existing organizations with a usable payload: the stored JSON object, else
    one built from the columns."""
    stored = F.when(F.trim("payload").rlike(r"^\{\s*[^\s}]") & F.try_parse_json("payload").isNotNull(), F.col("payload"))
    built = F.to_json(F.struct("title", "summary", "published_at", "source_url"), {"ignoreNullFields": "false"})
    return cells.withColumn("organization_id", F.trim("organization_id")).join(
        organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_semi").select(
        "organization_id", "kind", "position", F.coalesce(stored, built).alias("payload"))


def restored_collections(cells: DataFrame, organizations: DataFrame) -> DataFrame:
    """Payloads regrouped per organization into one array per kind. Arrays hold what one organization
    lists about itself; use `restored_payloads` where that is not bounded."""
    rows = restored_payloads(cells, organizations)
    shapes = {"projects": PROJECT, "news": NEWS, "jobs": TITLED, "tenders": TITLED}
    grouped = rows.groupBy("organization_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("position", "payload")))).alias(k) for k in shapes])

    def typed(kind: str) -> Column:
        fields = shapes[kind].removeprefix("STRUCT<").removesuffix(">").replace(":", "")
        return F.transform(kind, lambda s: F.from_json(s["payload"], fields)).alias(kind)

    return grouped.select("organization_id", *[typed(k) for k in shapes])
