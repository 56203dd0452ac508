"""Breadth-first walk of site link graphs, all sites at once, and the page context built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opporta.functions import url
from opporta.rules.link_rules import PROFILE_PATHS
from opporta.runtime import cut_lineage

# Fixed values.
MAX_DEPTH, MAX_PAGES, PROFILE_PAGES, QUEUE_FACTOR = 3, 200, 20, 6


def _first_per_site(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """First `limit` rows per site. Spark trims each task to `limit` rows per site before the shuffle."""
    if limit is None:
        return df
    return df.withColumn("_rn", F.row_number().over(W.partitionBy("site").orderBy(*order))).where(
        F.col("_rn") <= limit).drop("_rn")


def site_walk(seeds: DataFrame, edges: DataFrame, pages: DataFrame, sitemap: DataFrame | None = None,
              max_depth: int = MAX_DEPTH, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """Pages reached from the seeds: site, url, depth, in visiting order `path` within a depth.

    seeds and sitemap: site, url, position; edges: site, src_url, dst_url, position (same site only);
    pages: url of readable pages. Sitemap entries enter at depth 1. The order key is the chain of link
    positions, so no global numbering is needed. One join round per depth, each cut with a checkpoint.
    """
    queue_cap = None if max_pages is None else max_pages * QUEUE_FACTOR
    readable = pages.select("url").distinct()
    start = seeds.select("site", "url", F.array(F.col("position").cast("bigint")).alias("path"))
    frontier = cut_lineage(start.groupBy("site", "url").agg(F.min("path").alias("path")).withColumn("depth", F.lit(0)))
    queued = frontier
    hops = edges.select("site", F.col("src_url").alias("url"), "dst_url", "position")
    for depth in range(1, max_depth + 1):
        step = frontier.join(readable, "url", "left_semi").join(hops, ["site", "url"]).select(
            "site", F.col("dst_url").alias("url"),
            F.concat(F.array(F.lit(1).cast("bigint")) if depth == 1 else F.array().cast("array<bigint>"),
                     "path", F.array(F.col("position").cast("bigint"))).alias("path"))
        if depth == 1 and sitemap is not None:
            step = step.unionByName(sitemap.select(
                "site", "url", F.array(F.lit(0).cast("bigint"), F.col("position").cast("bigint")).alias("path")))
        fresh = step.groupBy("site", "url").agg(F.min("path").alias("path")).join(queued, ["site", "url"], "left_anti")
        frontier = cut_lineage(_first_per_site(fresh.withColumn("depth", F.lit(depth)), ["path", "url"], queue_cap))
        queued = queued.unionByName(frontier)
    found = queued.join(readable, "url", "left_semi")
    return _first_per_site(found, ["depth", "path", "url"], max_pages).select("site", "url", "depth", "path")


def ranked_profile_pages(pages: DataFrame, owner: str = "organization_id", limit: int = PROFILE_PAGES) -> DataFrame:
    """Pages that describe an organization first, then shorter URLs; `rank` up to `limit`."""
    relevant = F.when(url.path(F.col("url")).rlike(PROFILE_PATHS), 0).otherwise(1)
    window = W.partitionBy(owner).orderBy(relevant, F.length("url"), "url")
    return pages.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def page_block(link: Column, title: Column, content: Column) -> Column:
    return F.concat(F.lit("URL: "), link, F.lit("\nTiêu đề: "), F.coalesce(title, F.lit("")), F.lit("\nNội dung: "), content)


def site_context(pages: DataFrame, owner: str = "organization_id", limit: int = PROFILE_PAGES) -> DataFrame:
    """One text per organization from its best pages (at most `limit`, so the list is bounded)."""
    ranked = ranked_profile_pages(pages.where("trim(raw_content) <> ''"), owner, limit)
    blocks = ranked.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(
        "rank", page_block(F.col("url"), F.col("title"), F.col("raw_content")).alias("block")))).alias("blocks"))
    return blocks.select(owner, F.size("blocks").alias("pages_used"),
                         F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n---\n\n").alias("context"))


def candidate_blocks(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Each search result with the page that was loaded for it, found by requested or final URL.

    pages: source_url (requested), url (final), text, position; a later page replaces an earlier one.
    """
    named = pages.select(F.explode(F.array_compact(F.array("source_url", "url"))).alias("k"), "text", "position")
    latest = named.groupBy("k").agg(F.max_by("text", "position").alias("text"), F.max("position").alias("position"))  # one canonical form a spelling, not a load
    keyed = latest.select(url.canonical(F.col("k")).alias("key"), "text", "position").groupBy("key").agg(F.max_by("text", "position").alias("page_text"))
    joined = results.withColumn("key", url.canonical(F.col("url"))).join(keyed, "key", "left")
    block = F.concat(
        F.lit("[URL "), F.col("position").cast("string"), F.lit("]\nURL: "), F.col("url"), F.lit("\nTiêu đề: "), F.coalesce("title", F.lit("")),
        F.lit("\nĐoạn trích: "), F.coalesce("snippet", F.lit("")),
        F.lit("\nNội dung tải được: "), F.coalesce("page_text", F.lit("(không tải được)")))
    return joined.select("query", "position", "url", F.col("page_text").isNotNull().alias("loaded"), block.alias("block"))


def not_attempted(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Search results whose page was not tried in an earlier attempt."""
    tried = attempts.select(url.canonical(F.col("url")).alias("key")).distinct()
    return results.withColumn("key", url.canonical(F.col("url"))).join(tried, "key", "left_anti").drop("key")
