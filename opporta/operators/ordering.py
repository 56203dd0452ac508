"""Positions inside groups, quotas and stop rules, safe for a group with a third of all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opporta.runtime import cut_lineage

def with_row_number(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position (bigint) of each row inside its group; `order` must be unique inside a group.

    Rows are range-partitioned on key and order, so a hot group is split over many tasks; each task numbers
    its slice and adds the sizes of the slices before it. No task holds a whole group.
    """
    slices = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = slices.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = slices.withColumn("_pos", F.row_number().over(W.partitionBy("_slice", *keys).orderBy(*order)))
    same = F.lit(True)
    for k in (*keys, "_slice"):
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    joined = local.alias("a").join(before.alias("b"), same).select("a.*", "b._before")
    return joined.withColumn(out, F.col("_pos") + F.col("_before")).drop(
        "_slice", "_pos", "_before")


def fair_interleave(items: DataFrame, source_order: str = "source_order", position: str = "position", batch: int = 25) -> DataFrame:
    """Round-robin: `batch` items per source and round. Sort by (round, source order, number) to run."""
    numbered = with_row_number(items, [source_order], [position], "number")
    return numbered.withColumn("round", F.floor((F.col("number") - 1) / batch).cast("int") + 1)


def balanced_top(candidates: DataFrame, keywords: list[str], max_items: int | None = None, max_queries: int | None = None,
                 per_keyword: int = 10) -> DataFrame:
    """Candidate URLs per source, balanced over its search keywords.

    Each keyword in turn takes its first `ceil(max / keywords)` URLs (`per_keyword` without a maximum) not
    taken before; then the list is cut to the maximum. candidates: source_id, keyword, position, target_url.
    Keywords before the k-th have taken at most k times the quota, so the first (k + 1) quotas of a keyword hold
    all it can take. Spark keeps only those, per task before the shuffle; what is left of a source is bounded by
    keywords and quota, and one pass over it takes the URLs. One plan, whatever the number of keywords.
    """
    used = list(dict.fromkeys(keywords[: min((n for n in (max_queries, max_items) if n), default=len(keywords))]))
    if not used:
        return candidates.limit(0).withColumn("keyword_order", F.lit(0))
    quota = max(1, -(-(max_items or len(used) * per_keyword) // len(used)))
    kinds = dict(candidates.dtypes)

    def taken(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("keyword_order", "ascending"), ("position", "ascending"), ("target_url", "ascending")])
        seen: set[str] = set()
        count, keep = [0] * len(used), []
        for row, (order, target) in enumerate(zip(rows["keyword_order"].to_pylist(), rows["target_url"].to_pylist(), strict=True)):
            if max_items and len(keep) == max_items:
                break
            if count[order] < quota and target not in seen:
                seen.add(target)
                count[order] += 1
                keep.append(row)
        return rows.take(pa.array(keep, pa.int64()))
    order = F.element_at(F.create_map(*[x for k, word in enumerate(used) for x in (F.lit(word), F.lit(k))]), F.col("keyword"))
    own = candidates.where(F.col("keyword").isin(used)).groupBy("source_id", "keyword", "target_url").agg(F.min("position").alias("position"))
    ranked = own.withColumn("keyword_order", order).withColumn("_rn", F.row_number().over(W.partitionBy("source_id", "keyword").orderBy("position", "target_url")))
    near = ranked.where(F.col("_rn") <= quota * len(used)).where(F.col("_rn") <= quota * (F.col("keyword_order") + 1))
    return near.select("source_id", "target_url", "keyword", "keyword_order", "position").groupBy("source_id").applyInArrow(
        taken, f"source_id {kinds['source_id']}, target_url string, keyword string, keyword_order int, position {kinds['position']}")


def listing_stop(links: DataFrame, since: Column | None = None, max_pages: int | None = None) -> DataFrame:
    """Listing pages read before the stop rule fires. links: source_id, page, full_url, item_date.

    Reading stops at the first page after page 1 without a new link, and, with a time window, at the
    first page after page 2 without an item dated inside it (undated items do not count as inside).
    The stopping page itself was read. With `max_pages`, later pages are not looked at.
    """
    inside = F.lit(True) if since is None else F.coalesce(F.col("item_date") >= since, F.lit(True))
    dated_inside = F.lit(True) if since is None else F.coalesce(F.col("item_date") >= since, F.lit(False))
    near = links if max_pages is None else links.where(F.col("page") <= max_pages)
    # A link out of the window is not taken, so it is not new either.
    firsts = near.where(inside).groupBy("source_id", "full_url").agg(F.min("page").alias("page")).groupBy(
        "source_id", "page").agg(F.count("*").alias("new_links"))
    pages = near.groupBy("source_id", "page").agg(F.bool_or(dated_inside).alias("has_inside")).join(
        firsts, ["source_id", "page"], "left").withColumn("new_links", F.coalesce("new_links", F.lit(0)))
    stops = ((F.col("page") > 1) & (F.col("new_links") == 0))
    if since is not None:
        stops = stops | ((F.col("page") > 2) & ~F.col("has_inside"))
    earlier = W.partitionBy("source_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("stops", stops).withColumn(
        "_stopped", F.coalesce(F.bool_or("stops").over(earlier), F.lit(False))).where("NOT _stopped").drop("_stopped")
