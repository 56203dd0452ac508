"""Raw pages to items: title, content, publication date, and job posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import dates, text as tx, url
from opporta.operators.pages import with_page_fields
from opporta.rules import parse_rules as rules

_JOB_FIELDS = "ARRAY<STRUCT<`@type`: STRING, title: STRING, hiringOrganization: STRING, datePosted: STRING>>"


# Page fields an item is made of: all but links.
ITEM_FIELDS = ("h1", "h1_spaced", "h1_title", "h1_heading", "h2", "page_title", "title_block", "og_title", "description", "company",
               "json_ld", "json_dates", "metas", "date_elements", "paragraphs", "visible_text", "body_text")


def _first_date(values: Column, now: Column) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: dates.published_candidate(v, now)), lambda d: d.isNotNull()), 0)


def _labelled_date(text: Column) -> Column:
    """The first day, with a time before or after it, that follows a publication word and at most a colon or dash."""
    time, day = r"\d{1,2}:\d{2}", r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
    words = "|".join(r"\s*".join(w.split()) if not w.isascii() else r"\s+".join(w.split()) for w in sorted(rules.PUBLISHED_WORDS, key=len, reverse=True))
    return F.regexp_extract(text, rf"(?iu)(?:{words})\s*[:\-]?\s*((?:{time}\s+)?{day}(?:\s+{time})?)", 1)


def published_at(now: Column) -> Column:
    """Publication date by rank of evidence: JSON-LD, publication meta, labelled text, date elements.

    A bare date in title or body never counts: it is mostly a deadline. A publication label in the
    text ends the search even when its date is unreadable.
    """
    def is_publication(meta: Column) -> Column:
        marker = meta["marker"]
        return (~tx.contains_any(marker, rules.CHANGED_META)
                & tx.contains_any(marker, rules.PUBLISHED_META))
    metas = F.transform(F.filter(F.col("metas"), is_publication), lambda m: m["content"])
    labelled = _labelled_date(F.col("visible_text"))
    visible = F.when(labelled != "", F.array(labelled)).otherwise(F.col("date_elements"))
    return _first_date(F.concat(F.col("json_dates"), metas, visible), now)


def rule_of(source: Column, mode: Column | None = None) -> Column:
    """Parse rule of a source: generic when the mode says so or the source is not a known one."""
    known = source.isin(*[r[0] for r in rules.PARSE_RULES])
    if mode is not None:
        known = known & (F.coalesce(mode, F.lit("specialized")) != "generic")
    return F.when(known, source).otherwise("generic")


def _title(rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for source_id, fields, suffixes, default, _ in rules.PARSE_RULES:
        found = F.coalesce(*[tx.blank_to_null(F.col(f)) for f in fields])
        if source_id == "generic":
            trail = F.replace(F.regexp_replace(url.path(F.col("url")), "^/+|/+$", ""), F.lit("-"), F.lit(" "))
            found = F.coalesce(found, tx.blank_to_null(trail), F.col("source_id"))
        elif default:
            found = F.coalesce(found, F.lit(default))
        for suffix in suffixes:
            found = F.trim(F.regexp_replace(found, "(?iu)" + suffix, ""))
        if source_id == "muasamcong":
            empty = (F.length(found) < 5) | F.lower(found).isin(*rules.EMPTY_TENDER_TITLES)
            found = F.when(empty, rules.TENDER_TITLE).otherwise(found)
        out = F.when(rule == source_id, found).otherwise(out)
    return out


def labelled_lines(content: Column) -> Column:
    """`label: value` lines of the procurement fields found in a flat text, in label order.

    A text is cut at each place of a label. What follows, up to the first label that may come next, is a value if it has a fitting
    length and is no heading of a list page; the first one counts.
    """
    def line(shown: str, label: str, following: list[str], most: int) -> Column:
        after = F.split(content, rf"(?iu){label}(?=\s)")
        pieces = F.transform(F.slice(after, 2, F.size(after)), lambda p: F.split(p, rf"(?iu)\s+(?:{'|'.join(following)})\b", 2))
        values = F.transform(F.filter(pieces, lambda p: F.size(p) == 2), lambda p: F.regexp_replace(tx.squeeze(p[0]), r"^[ :\-]+|[ :\-]+$", ""))
        good = F.filter(values, lambda v: F.length(v).between(rules.LEAST_VALUE, most) & ~tx.contains_any(F.lower(v), [w.lower() for w in rules.LABELLED_NOISE]))
        return F.concat(F.lit(f"{shown}: "), F.get(good, 0))
    return F.array_compact(F.array(*[line(*f) for f in rules.LABELLED_FIELDS]))


def parse_items(raw: DataFrame, now: Column) -> DataFrame:
    """One row per raw page in the shape of PARSED_ITEMS; `error` says why a page gave no item."""
    keep = ["url", "source_id", "fetched_at"] + [c for c in ("adapter_mode", "snapshot_path") if c in raw.columns]
    pages = with_page_fields(raw, keep, ITEM_FIELDS)
    mode = F.col("adapter_mode") if "adapter_mode" in raw.columns else None
    jobs = F.flatten(F.transform(F.col("json_ld"), lambda j: F.coalesce(
        F.from_json(j, _JOB_FIELDS), F.from_json(F.lit("[]"), _JOB_FIELDS))))
    is_job = F.col("rule") == "topcv"
    firm = F.col("job.hiringOrganization")
    kinds = {r[0]: r[4] for r in rules.PARSE_RULES}

    def of_kind(kind: str) -> Column:
        return F.col("rule").isin(*[s for s, k in kinds.items() if k == kind])

    # One value per step: later steps name it instead of repeating its expression.
    staged = (
        pages.withColumn("rule", rule_of(F.col("source_id"), mode))
        .withColumn("job", F.when(is_job, F.get(F.filter(jobs, lambda j: F.lower(j["@type"]) == "jobposting"), 0)))
        .withColumn("dated", published_at(now))
        .withColumn("ruled_title", _title(F.col("rule")))
        .withColumn("title", F.when(is_job, F.coalesce(
            tx.blank_to_null(tx.squeeze(F.col("job.title"))), F.col("ruled_title"))).otherwise(F.col("ruled_title")))
        .withColumn("firm", F.when(is_job, F.coalesce(
            tx.blank_to_null(tx.squeeze(F.when(firm.startswith("{"), F.get_json_object(firm, "$.name")))),
            tx.blank_to_null(F.col("company")))))
        .withColumn("lines", F.when(of_kind("labelled"), F.concat(
            labelled_lines(F.col("visible_text")), F.array_compact(F.array(
                F.concat(F.lit("Ngày đăng: "), F.date_format(F.col("dated"), "dd/MM/yyyy HH:mm"))))))))
    body = (
        F.when(of_kind("description"), F.concat(F.coalesce(F.col("description"), F.lit("")), F.lit("\n"), F.col("visible_text")))
        .when(of_kind("paragraphs") & (F.size("paragraphs") > 0), F.array_join("paragraphs", "\n\n"))
        .when(of_kind("labelled"), F.array_join(F.concat("lines", F.array("visible_text")), "\n"))
        .when(is_job & F.col("firm").isNotNull(), F.concat(F.lit("Đơn vị tuyển dụng: "), F.col("firm"), F.lit("\n"), F.col("visible_text")))
        .when(F.col("rule") == "generic", F.col("body_text"))
        .otherwise(F.col("visible_text")))
    error = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when((F.col("rule") == "generic") & (F.col("body_text") == "") | (F.col("rule") == "topcv") & (F.col("visible_text") == ""), "no text")
        .when(is_job & tx.blank_to_null(F.col("title")).isNull(), "no title"))
    return staged.select(
        *keep, F.when(F.col("rule").isin("generic", "topcv"), F.left("title", F.lit(500))).otherwise(F.col("title")).alias("title"),
        body.alias("raw_content"),
        F.when(is_job, F.coalesce(dates.parse_datetime(F.col("job.datePosted"), now), F.col("dated")))
        .otherwise(F.col("dated")).alias("published_at"),
        F.col("firm").alias("author"), error.alias("error"))


def accepted(items: DataFrame) -> DataFrame:
    return items.where("error IS NULL")


def rejected(items: DataFrame) -> DataFrame:
    return items.where("error IS NOT NULL").select("url", "source_id", "error")
