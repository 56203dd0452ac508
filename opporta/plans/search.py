"""Lead search and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from opporta.functions import labels
from opporta.operators.ordering import with_row_number

SEARCHED = ["title", "organization_name", "need_summary", "budget_text"]


def _contains(col: str, text: str, escape: bool) -> Column:
    """Case-blind substring test. `%` and `_` in the text act as wildcards unless escaped."""
    if escape:
        for mark in ("\\", "%", "_"):
            text = text.replace(mark, "\\" + mark)
    return F.col(col).ilike(f"%{text}%")


def filter_leads(leads: DataFrame, *, source: str | None = None, action: str | None = None, status: str | None = None,
                 include_archived: bool = False, min_score: int | None = None, max_score: int | None = None,
                 location: str | None = None, query: str | None = None, category: str | None = None, escape: bool = False) -> DataFrame:
    """Filters combine with AND. Without a status, archived leads and leads without status are hidden.
    `category` is accepted and has no effect."""
    out = leads
    if source:
        out = out.where(F.col("source") == source)
    if action:
        out = out.where(F.col("recommended_action") == action)
    if status:
        out = out.where(F.col("status") == status)
    elif not include_archived:
        out = out.where(F.col("status") != "ARCHIVED")
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if max_score is not None:
        out = out.where(F.col("score") <= max_score)
    if location:
        out = out.where(_contains("location", location, escape))
    if query:
        hit = F.lit(False)
        for name in SEARCHED:
            hit = hit | _contains(name, query, escape)
        out = out.where(hit)
    return out


def lead_page(leads: DataFrame, page: int = 1, page_size: int = 20, sort_by: str = "score", sort_order: str = "desc") -> DataFrame:
    """One page. Ties end at the id, so pages never overlap. Runs as a top-k, not a full sort."""
    column = F.col(sort_by if sort_by in leads.columns else "score")
    if sort_order.lower() == "asc":
        order = [column.asc_nulls_first(), F.col("id").asc()]
    else:
        order = [column.desc_nulls_last(), F.col("crawled_at").desc_nulls_last(), F.col("id").asc()]
    return leads.orderBy(*order).offset((page - 1) * page_size).limit(page_size).withColumn("badge", labels.score_badge(F.col("score")))


def _best_first() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("crawled_at").desc_nulls_last(), F.col("id").asc()]


def page_after(leads: DataFrame, last: Row | None, page_size: int = 20) -> DataFrame:
    """The page behind the row `last` (score, crawled_at, id) in the default order; the first page without one.

    The filter reaches the scan, and what passes it runs as a top-k: no task ever sorts or holds more than a page, however
    deep the page is.
    """
    rest = leads
    if last is not None:
        score, at = F.col("score"), F.col("crawled_at")
        same_score = score.isNull() if last.score is None else score == last.score
        same_at = at.isNull() if last.crawled_at is None else at == F.lit(last.crawled_at)
        after = same_score & same_at & (F.col("id") > last.id)
        if last.crawled_at is not None:
            after = after | same_score & (at.isNull() | (at < F.lit(last.crawled_at)))
        if last.score is not None:
            after = after | score.isNull() | (score < last.score)
        rest = leads.where(after)
    return rest.orderBy(*_best_first()).limit(page_size).withColumn("badge", labels.score_badge(F.col("score")))


def page_ends(leads: DataFrame, page_size: int = 20) -> DataFrame:
    """`page, score, crawled_at, id` of the last row of every full page, numbered in range slices. Only the keys move.

    Store it to jump to any page with `page_after`.
    """
    keys = leads.select(F.coalesce(-F.col("score"), F.lit(2**31 - 1)).alias("_s"), F.coalesce(-F.unix_micros(F.col("crawled_at").cast("timestamp")), F.lit(2**63 - 1)).alias("_t"),
                        "id", "score", "crawled_at")
    numbered = with_row_number(keys, [], ["_s", "_t", "id"], "_row")
    return numbered.where(F.col("_row") % page_size == 0).select((F.col("_row") / page_size).cast("bigint").alias("page"), "score", "crawled_at", "id")


def seek_page(leads: DataFrame, page: int, page_size: int = 20) -> DataFrame:
    """One page of the default order, as `lead_page` gives it, by seeking the row before it."""
    if page <= 1:
        return page_after(leads, None, page_size)
    before = page_ends(leads, page_size).where(F.col("page") == page - 1).first()
    return leads.limit(0).withColumn("badge", F.lit("")) if before is None else page_after(leads, before, page_size)


def search_leads(leads: DataFrame, page: int = 1, page_size: int = 20, sort_by: str = "score", sort_order: str = "desc", **filters) -> DataFrame:
    return lead_page(filter_leads(leads, **filters), page, page_size, sort_by, sort_order)


def page_totals(leads: DataFrame, page_size: int = 20, **filters) -> DataFrame:
    return filter_leads(leads, **filters).agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / page_size).cast("bigint"))


def lead_profiles(leads: DataFrame, organizations: DataFrame) -> DataFrame:
    """Leads with the profile fields of their organization; error texts in profile fields are hidden."""
    shown = ["industry", "size", "employee_count", "official_url"]
    orgs = organizations.select(F.col("id").alias("organization_id"), "legal_name", "domain", "tax_code", "profile_status",
                                *[labels.hide_technical(F.col(c)).alias(c) for c in shown])
    return leads.join(orgs, "organization_id", "left")


def lead_children(leads: DataFrame, children: DataFrame) -> DataFrame:
    """Contacts or evidence of leads, one row each, so no lead gathers an unbounded list. Order contacts
    by `decision_score` descending to show them."""
    return leads.select(F.col("id").alias("lead_id"), "organization_id").join(children, "organization_id")


def lead_detail(leads: DataFrame, organizations: DataFrame, contacts: DataFrame, evidence: DataFrame, lead_id: str) -> dict[str, DataFrame]:
    """Everything shown for one lead: the filter comes first, so the joins touch one organization."""
    one = leads.where(F.col("id") == lead_id)
    return {"lead": lead_profiles(one, organizations),
            "contacts": lead_children(one, contacts).orderBy(F.col("decision_score").desc_nulls_last(), "id"),
            "evidence": lead_children(one, evidence).orderBy("id")}
