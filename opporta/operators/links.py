"""Link extraction: section links, keyword-search links, and the link graph of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import addresses, dates, url
from opporta.operators.pages import with_links, with_page_fields
from opporta.rules import link_rules as rules

FIELDS = ("position", "href", "text", "in_chrome", "near_date", "target_url")
SECTION_FIELDS = ("position", "href", "near_date")  # what `section_links` asks of a link


def page_links(raw: DataFrame, keep: tuple[str, ...] = ("source_id",), with_context: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per anchor: resolved URL, canonical URL, text and the date of its block; `fields` names those to be made.

    `with_context` adds the text of the enclosing block, which keyword search needs.
    """
    if not with_context:
        wanted = ["resolved" if f == "target_url" else f for f in fields]
        rows = with_links(raw, ["url", *keep], tuple(wanted)).select(F.col("url").alias("page_url"), *keep, *wanted)
    else:
        pages = with_page_fields(raw, ["url", *keep], ("links", "blocks"))
        names = [*(f for f in FIELDS if f != "target_url"), "resolved"]

        def entry(link: Column) -> Column:
            # The block text joins its link before the explode, so a row never carries the whole page.
            return F.struct(*[link[n].alias(n) for n in names], F.get(F.col("blocks"), link["block"]).alias("context"))

        rows = pages.select(F.col("url").alias("page_url"), *keep, F.explode(F.transform("links", entry)).alias("link")).select("page_url", *keep, "link.*")
    if "target_url" not in fields:
        return rows.drop("resolved")
    return rows.withColumn("target_url", url.canonical(F.col("resolved"))).drop("resolved")


def navigable(href: Column) -> Column:
    return (href != "") & ~F.lower(href).rlike(r"^(?:#|javascript:|mailto:|tel:)")


def section_links(links: DataFrame, now: Column, since: Column | None = None, rule_col: str = "source_id") -> DataFrame:
    """Item links of section pages by the rules of each source, first occurrence per source.

    The rules are constants of the plan (a few rows), so every link meets its rule without a join.
    """
    source, href = F.col(rule_col), F.col("href")
    fits, base, least, dated = F.lit(False), F.lit(None).cast("string"), F.lit(0), F.lit(False)
    for source_id, include, exclude, prefix, longer_than, is_dated in rules.LINK_RULES:
        own = source == source_id
        accepted = href.rlike(include) & ~href.rlike(exclude) if exclude else href.rlike(include)
        fits, base = F.when(own, accepted).otherwise(fits), F.when(own, prefix).otherwise(base)
        least, dated = F.when(own, longer_than).otherwise(least), F.when(own, is_dated).otherwise(dated)
    kept = links.where(fits).withColumn("full_url", F.when(href.startswith("http"), href).otherwise(F.concat(base, href))).where(
        F.length("full_url") > least)
    if since is not None:
        older = F.when(dated & F.col("near_date").isNotNull(), dates.parse_datetime(F.col("near_date"), now) < since)
        kept = kept.where(~F.coalesce(older, F.lit(False)))
    return kept.groupBy(rule_col, "full_url").agg(F.min(F.struct("page_url", "position")).alias("seen")).select(
        rule_col, "full_url", "seen.page_url", "seen.position")


def search_links(links: DataFrame) -> DataFrame:
    """Candidate article links of keyword-search pages (`keyword` says what was searched).

    Outside page chrome, on an allowed host, of article shape, with the keyword in the block text.
    """
    fits = F.lit(False)
    for source_id, pattern, hosts in rules.SEARCH_RULES:
        fits = F.when(F.col("source_id") == source_id, url.host(F.col("target_url")).isin(*hosts)
                      & F.col("target_url").rlike("(?i)" + pattern)).otherwise(fits)
    return links.where(  # cheap ones first: a canonical URL is only made for what they leave
        ~F.col("in_chrome") & navigable(F.col("href")) & F.contains(F.lower("context"), F.lower("keyword")) & fits)


def site_edges(links: DataFrame) -> DataFrame:
    """Same-host links a site walk may follow: safe, not a file, not a login or cart page."""
    target = F.col("target_url")
    allowed = (
        navigable(F.col("href")) & addresses.url_problem(target).isNull()
        & (url.host_key(F.col("page_url")) == url.host_key(target))
        & (F.lower(url.path(target)).endswith("/sitemap.xml") | ~target.rlike(rules.SKIP_EXTENSIONS))
        & ~url.path(target).rlike(rules.SKIP_PATHS))
    return links.where(allowed).groupBy(
        url.host_key(target).alias("site"), url.canonical(F.col("page_url")).alias("src_url"),
        target.alias("dst_url")).agg(F.min("position").alias("position"))


def pdf_links(links: DataFrame) -> DataFrame:
    """Same-host links to PDF files."""
    target = F.col("target_url")
    return links.where(
        F.lower(F.substring_index(target, "?", 1)).endswith(".pdf")
        & (url.host_key(target) == url.host_key(F.col("page_url")))).select("page_url", "target_url").distinct()
