"""Lead assembly, upsert, status changes, replay and sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import dates, ids, text as tx
from opporta.schemas import SCORE_THRESHOLD

# Fixed value: summary prefix of items still waiting for a model.
QUEUED_PREFIX = "[hàng đợi ai]"


def category_union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def is_processed(status: Column, summary: Column) -> Column:
    """A model has seen the lead."""
    waiting = F.lower(F.trim(F.coalesce(summary, F.lit("")))).startswith(QUEUED_PREFIX)
    return (F.upper(F.coalesce(status, F.lit(""))) != "PENDING_AI") & ~waiting


def primary_contacts(contacts: DataFrame, key: str = "organization_id", position: str = "position") -> DataFrame:
    """Contact with the highest decision score per organization (no score ranks last; ties by position)."""
    rank = F.struct(F.coalesce("decision_score", F.lit(-1)), -F.col(position))
    return contacts.groupBy(key).agg(F.max_by(F.struct("full_name", "email", "phone", "decision_score"), rank).alias("c")).select(
        key, F.col("c.full_name").alias("primary_name"), F.col("c.email").alias("primary_email"),
        F.col("c.phone").alias("primary_phone"), F.col("c.decision_score").alias("primary_score"))


def first_contacts_with(contacts: DataFrame, key: str = "organization_id", position: str = "position") -> DataFrame:
    """Display variant: for each field the first contact, by position, that has it."""
    fields = ("full_name", "email", "phone")
    return contacts.groupBy(key).agg(*[
        F.min_by(f, F.when(tx.blank_to_null(F.col(f)).isNotNull(), F.col(position))).alias(f) for f in fields])


def fill_contact(leads: DataFrame, primary: DataFrame, key: str = "organization_id") -> DataFrame:
    """Fill only the empty contact fields of leads."""
    joined = leads.join(primary, key, "left")
    return joined.withColumns({
        f"contact_{n}": F.coalesce(tx.blank_to_null(F.col(f"contact_{n}")), F.col(f"primary_{n}"))
        for n in ("name", "email", "phone")}).drop("primary_name", "primary_email", "primary_phone", "primary_score")


def evidence_notes(evidence: Column, found: Column) -> Column:
    """Lead evidence followed by the new `text — url` notes of the profile."""
    notes = F.transform(found, lambda e: F.concat(
        F.coalesce(e["evidence_text"], F.lit("None")), F.lit(" — "), F.coalesce(e["source_url"], F.lit("None"))))
    empty = F.array().cast("array<string>")
    base = F.coalesce(evidence, empty)
    return F.concat(base, F.array_except(F.coalesce(notes, empty), base))


def assemble_leads(items: DataFrame, extracted: DataFrame, profiles: DataFrame, scored: DataFrame, now: Column,
                   threshold: int = SCORE_THRESHOLD) -> DataFrame:
    """New leads from triaged items. Items carry doc_url, canonical_url, fingerprint, matches and dates;
    the other three are keyed by doc_url. Below-threshold scores give no lead."""
    best = F.array_max(F.transform("contacts", lambda c, i: F.struct(
        F.coalesce(c["decision_score"], F.lit(-1)).alias("s"), (-i).alias("i"), c["full_name"].alias("name"),
        c["email"].alias("email"), c["phone"].alias("phone"))))
    orgs = profiles.select("doc_url", "organization_id", "enrichment_status", "enrichment_message", best.alias("best"),
                           F.col("evidence").alias("profile_evidence"))
    joined = items.join(extracted, "doc_url").join(scored.where(F.col("total_score") >= threshold), "doc_url").join(orgs, "doc_url", "left")

    def contact(name: str) -> Column:
        return F.coalesce(tx.blank_to_null(F.col(f"contact_{name}")), F.col(f"best.{name}")).alias(f"contact_{name}")

    return joined.select(
        ids.lead_id(F.col("canonical_url")).alias("id"), F.col("source_id").alias("source"),
        F.col("canonical_url").alias("source_url"), "title", F.coalesce("published_at", "crawled_at").alias("published_at"), "crawled_at",
        "organization_name", F.coalesce("organization_type", F.lit("other")).alias("organization_type"), "need_summary",
        category_union(F.col("matched_groups"), F.col("need_categories")).alias("need_categories"), "budget_value", "budget_text",
        "location", contact("name"), contact("email"), contact("phone"),
        dates.parse_datetime(tx.squeeze(F.col("deadline")), now).alias("deadline"), F.col("matched_keywords").alias("keywords_matched"),
        "relevance", F.col("total_score").alias("score"), "recommended_action", "score_reasons",
        evidence_notes(F.col("evidence"), F.col("profile_evidence")).alias("evidence"), F.col("snapshot_path").alias("raw_content_ref"),
        F.col("fingerprint").alias("content_fingerprint"), "sales_strategy", F.lit("NEW").alias("status"),
        F.lit(None).cast("string").alias("sales_notes"), "organization_id", "enrichment_status", "enrichment_message",
        F.col("crawled_at").alias("updated_at"))


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Base rows without an update, plus the updates (one per key). An anti join, then a union."""
    return base.join(updates.select(key), key, "left_anti").select(*base.columns).unionByName(
        updates, allowMissingColumns=True)


def apply_status_changes(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per lead (id, new_status, notes, changed_at); notes only when given."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("new_status", "notes", "changed_at"), F.struct("changed_at", "new_status")).alias("c"))
    return leads.join(last, "id", "left").withColumns({
        "status": F.coalesce("c.new_status", "status"), "sales_notes": F.coalesce("c.notes", "sales_notes"),
        "updated_at": F.coalesce("c.changed_at", "updated_at")}).drop("c")


def sync_missing(leads: DataFrame, target: DataFrame, threshold: int = SCORE_THRESHOLD) -> DataFrame:
    """Processed, unarchived leads of enough score whose id the target lacks."""
    due = (is_processed(F.col("status"), F.col("need_summary")) & (F.upper(F.coalesce("status", F.lit(""))) != "ARCHIVED")
           & (F.coalesce("score", F.lit(0)) >= threshold))
    known = target.select(F.trim(F.col("id").cast("string")).alias("id")).where("id <> ''").distinct()
    return leads.where(due).join(known, "id", "left_anti")


def replay_pending(leads: DataFrame, snapshots: DataFrame, extracted: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """Waiting leads that now have answers: new extraction and score, categories united, status NEW.

    `extracted` and `scored` are keyed by `doc_url` = lead source URL; `snapshots` by snapshot_path give
    the text the answers were made from. Leads without answers stay out of the result.
    """
    waiting = leads.where("status = 'PENDING_AI'")
    own = [c for c in ("organization_name", "organization_type", "need_summary", "budget_value", "budget_text", "location", "contact_name",
                       "contact_email", "contact_phone", "relevance", "evidence", "deadline")]
    keys = ["recommended_action", "score_reasons", "sales_strategy"]
    fresh = waiting.drop(*own, *keys, "score").withColumnRenamed("need_categories", "_old").join(
        extracted, F.col("source_url") == F.col("doc_url")).drop("doc_url").join(
        scored, F.col("source_url") == F.col("doc_url")).drop("doc_url").join(
        snapshots.select(F.col("snapshot_path").alias("raw_content_ref"), F.lit(True).alias("has_snapshot")), "raw_content_ref", "left")
    return fresh.withColumns({
        "organization_type": F.coalesce("organization_type", F.lit("other")),
        "need_categories": category_union(F.col("_old"), F.col("need_categories")),
        "deadline": dates.parse_datetime(tx.squeeze(F.col("deadline")), now), "score": F.col("total_score"),
        "status": F.lit("NEW"), "updated_at": now, "has_snapshot": F.coalesce("has_snapshot", F.lit(False))}).drop("_old", "total_score")


def replay_contents(leads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Text to send again for waiting leads: the snapshot's text, else the title."""
    return leads.where("status = 'PENDING_AI'").join(
        snapshots.select(F.col("snapshot_path").alias("raw_content_ref"), "visible_text"), "raw_content_ref", "left").select(
        "id", "source_url", "title", F.coalesce(tx.blank_to_null(F.col("visible_text")), F.col("title")).alias("raw_content"))
