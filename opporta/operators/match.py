"""Keyword relevance with word-boundary semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import text as tx
from opporta.functions.terms import distinct_words, pattern_column, with_term_hits
from opporta.runtime import cut_lineage

INLINE_LIMIT = 3000
# Category of sources that skip the keyword test.
FEED_CATEGORY = "Nguồn tìm theo từ khóa"
CUSTOM_CATEGORY = "Website tùy chỉnh"


def match_keywords(items: DataFrame, keywords: DataFrame, item_id: str, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Add `matched_keywords`, `matched_groups` (sorted) and `is_relevant` to items (`title`, `raw_content`).

    A registry up to `inline_limit` keywords becomes constants of the plan: no shuffle at all. A larger
    one is joined on the anchor word, so neither way compares every text with every keyword. Both give the
    same answers: items need no unique or non-null `item_id`, and white space around keywords does not count.
    """
    bare = F.regexp_replace("keyword", r"(?U)^\s+|\s+$", "")
    active = keywords.where("use_for_filter AND active").select(bare.alias("keyword"), "group_name").where("keyword <> ''")
    known = active.limit(inline_limit + 1).collect()
    staged = items.withColumn("_text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("raw_content", F.lit(""))))
    if len(known) <= inline_limit:
        terms = [r.keyword for r in known]
        groups = [r.group_name for r in known]
        pick = with_term_hits(staged, F.col("_text"), terms, "_hits")
        out = pick.withColumn("matched_keywords", _named("_hits", terms)).withColumn(
            "matched_groups", _named("_hits", groups)).drop("_hits", "_text")
    else:
        out = _joined(staged, active)
    return out.withColumn("is_relevant", F.size("matched_keywords") > 0)


def _named(hits: str, values: list[str]) -> Column:
    """Sorted distinct values at the hit positions."""
    if not values:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.get(F.array(*map(F.lit, values)), i))))


def _joined(items: DataFrame, active: DataFrame) -> DataFrame:
    # A row number joins the hits back to their row; the checkpoint keeps it from changing.
    staged = cut_lineage(items.withColumn("_row", F.monotonically_increasing_id()))
    by_length = F.array_sort(F.filter(F.split(F.lower("keyword"), tx.NOT_WORD + "+"), lambda w: w != ""),
                             lambda a, b: F.length(b) - F.length(a))
    terms = active.select("keyword", "group_name", F.get(by_length, 0).alias("anchor"))
    words = staged.select("_row", F.explode(distinct_words(F.lower("_text"))).alias("anchor"))
    # A term without a word character has no anchor; it is looked for by its first character.
    loose = terms.where("anchor IS NULL").select("keyword", "group_name", F.left(F.lower("keyword"), F.lit(1)).alias("anchor"))
    signs = staged.select("_row", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("_text"), tx.WORD + "+", ""), ""))).alias("anchor"))
    candidates = words.join(terms.where("anchor IS NOT NULL"), "anchor").unionByName(signs.join(loose, "anchor"))
    # No more candidates than the text has different words and signs with terms of their own.
    found = candidates.groupBy("_row").agg(F.collect_set(F.struct("keyword", "group_name")).alias("_cand"))
    struct = "array<struct<keyword:string,group_name:string>>"
    checked = staged.join(found, "_row", "left").withColumn("_low", F.lower("_text")).withColumn("_hits", F.filter(
        F.coalesce("_cand", F.array().cast(struct)), lambda c: F.regexp_like(F.col("_low"), pattern_column(c["keyword"]))))
    return checked.withColumn("matched_keywords", F.array_sort(F.array_distinct(F.transform("_hits", lambda c: c["keyword"])))).withColumn(
        "matched_groups", F.array_sort(F.array_distinct(F.transform("_hits", lambda c: c["group_name"])))).drop(
        "_cand", "_low", "_hits", "_text", "_row")


def bypass_keywords(matched: DataFrame, discovery: list[str], mode: str = "adapter_mode", feed: str = "is_keyword_feed") -> DataFrame:
    """Custom sites and keyword feeds are always relevant: fixed category; feeds record the whole
    discovery list, custom sites no keyword."""
    is_feed = F.coalesce(F.col(feed), F.lit(False))
    is_custom = F.coalesce(F.col(mode), F.lit("")) == "generic"
    terms = F.array(*map(F.lit, discovery)).cast("array<string>")
    none = F.array().cast("array<string>")
    return matched.withColumns({
        "matched_keywords": F.when(is_feed, terms).when(is_custom, none).otherwise(F.col("matched_keywords")),
        "matched_groups": F.when(is_feed, F.array(F.lit(FEED_CATEGORY))).when(is_custom, F.array(F.lit(CUSTOM_CATEGORY)))
        .otherwise(F.col("matched_groups")),
        "is_relevant": is_feed | is_custom | F.col("is_relevant")})
