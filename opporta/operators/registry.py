"""Keyword and source registries: seed, clean, import, upsert, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import addresses, ids, text as tx, url
from opporta.operators.dedup import first_wins
from opporta.rules.parse_rules import PARSE_RULES

# Fixed values.
CUSTOM_GROUP = ("custom", "Từ khóa tùy chỉnh")
MAX_IMPORT, MAX_LENGTH, MAX_DISCOVERY = 1000, 160, 20
NOTICE = "Nguồn này chưa crawl được, cần cập nhật adapter sau."


def seed_keywords(discovery: DataFrame, groups: DataFrame) -> DataFrame:
    """Merge a discovery list (keyword, position) and groups (group_id, group_name, keyword, position).

    Case-folded text is the key. Discovery rows come first and keep their spelling; group membership
    makes a keyword a filter; of several groups the last one wins.
    """
    none = F.lit(None).cast("string")
    rows = discovery.select(F.lit(0).alias("part"), "position", "keyword", none.alias("group_id"), none.alias("group_name")).unionByName(
        groups.select(F.lit(1).alias("part"), "position", "keyword", "group_id", F.coalesce(tx.blank_to_null(F.col("group_name")), "group_id").alias("group_name")))
    clean = rows.withColumn("keyword", tx.normalize(F.col("keyword"))).where("keyword <> ''").withColumn("key", tx.casefold(F.col("keyword")))
    at = F.struct("part", "position")
    in_group = F.col("part") == 1
    merged = clean.groupBy("key").agg(
        F.min_by("keyword", at).alias("keyword"), F.min(at).alias("first_seen"),
        F.max_by("group_id", F.when(in_group, F.col("position"))).alias("group_id"),
        F.max_by("group_name", F.when(in_group, F.col("position"))).alias("group_name"),
        F.bool_or(in_group).alias("use_for_filter"), F.bool_or(~in_group).alias("use_for_discovery"))
    return merged.select(
        "keyword", F.coalesce("group_id", F.lit(CUSTOM_GROUP[0])).alias("group_id"), F.coalesce("group_name", F.lit(CUSTOM_GROUP[1])).alias("group_name"),
        "use_for_filter", "use_for_discovery", F.lit(True).alias("active"), "first_seen")


def clean_keywords(rows: DataFrame, position: str = "position") -> DataFrame:
    """Active stored rows, first row per case-folded keyword, tolerant booleans and defaults."""
    clean = rows.select(
        position, tx.normalize(F.col("keyword")).alias("keyword"),
        F.coalesce(tx.blank_to_null(tx.normalize(F.col("group_id"))), F.lit(CUSTOM_GROUP[0])).alias("group_id"),
        F.coalesce(tx.blank_to_null(tx.normalize(F.col("group_name"))), F.lit(CUSTOM_GROUP[1])).alias("group_name"),
        tx.as_bool(F.col("use_for_filter"), True).alias("use_for_filter"), tx.as_bool(F.col("use_for_discovery"), False).alias("use_for_discovery"),
        tx.as_bool(F.col("active"), True).alias("active")).where("keyword <> '' AND active")
    return first_wins(clean.withColumn("key", tx.casefold(F.col("keyword"))), ["key"], [position]).drop("key")


def import_keywords(contents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per pasted text: `keywords` (order kept, case-folded repeats dropped) and `error`.

    Splits on comma, semicolon and line ends. All work stays inside the row: no shuffle.
    """
    parts = F.filter(F.transform(F.split(tx.nfkc(F.col(content)), r"[,;\r\n]+"), tx.squeeze), lambda k: k != "")
    staged = contents.select(key, F.coalesce(parts, F.array().cast("array<string>")).alias("parts")).withColumn(
        "keys", F.transform("parts", tx.casefold)).withColumn("distinct_keys", F.size(F.array_distinct("keys")))
    error = (F.when(F.size("parts") == 0, "empty").when(F.exists("parts", lambda k: F.length(k) > MAX_LENGTH), "keyword too long")
             .when(F.col("distinct_keys") > MAX_IMPORT, "too many keywords"))
    firsts = F.when(F.col("distinct_keys") == F.size("parts"), F.col("parts")).otherwise(
        F.filter("parts", lambda k, i: F.array_position("keys", F.get("keys", i)) == i + 1))
    return staged.withColumn("error", error).select(
        key, F.when(F.col("error").isNull(), firsts).otherwise(F.array().cast("array<string>")).alias("keywords"), "error")


def discovery_budget(stored: DataFrame, requested: DataFrame, limit: int = MAX_DISCOVERY) -> DataFrame:
    """How many keywords would be searched directly, and whether that is within the limit."""
    folded = lambda df: df.select(tx.casefold(tx.normalize(F.col("keyword"))).alias("key"))
    both = folded(stored.where("use_for_discovery")).unionByName(folded(requested)).where("key <> ''")
    return both.agg(F.count_distinct("key").cast("bigint").alias("keywords")).withColumn("within_limit", F.col("keywords") <= limit)


def upsert_keywords(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Classify and merge by case-folded keyword: `added`, `promoted` (now also searched), `duplicate`, `kept`.

    Repeats inside `incoming` (by position) count as duplicates in `duplicates` of their row.
    """
    def keyed(df: DataFrame, prefix: str, aggs: list) -> DataFrame:
        return df.withColumn("key", tx.casefold(F.trim("keyword"))).where("key <> ''").groupBy("key").agg(*aggs)
    fields = ["keyword", "group_id", "group_name", "use_for_filter", "use_for_discovery"]
    old = keyed(stored, "o", [F.min_by(F.struct(*fields), "position").alias("o")])
    new = keyed(incoming, "n", [F.min_by(F.struct(*fields), "position").alias("n"), F.count("*").alias("rows"),
                                F.bool_or("use_for_discovery").alias("wants")])
    promoted = F.col("n").isNotNull() & F.col("o").isNotNull() & F.col("wants") & ~F.col("o.use_for_discovery")
    action = (F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "added").when(promoted, "promoted").otherwise("duplicate"))
    changed = F.col("n").isNotNull() & action.isin("added", "promoted")
    return old.join(new, "key", "full").select(
        "key", action.alias("action"), F.coalesce("o.keyword", "n.keyword").alias("keyword"),
        F.coalesce("o.group_id", "n.group_id").alias("group_id"), F.coalesce("o.group_name", "n.group_name").alias("group_name"),
        F.when(promoted, F.lit(True)).otherwise(F.coalesce("o.use_for_filter", "n.use_for_filter")).alias("use_for_filter"),
        F.when(promoted, F.lit(True)).otherwise(F.coalesce("o.use_for_discovery", "n.use_for_discovery")).alias("use_for_discovery"),
        (F.coalesce("rows", F.lit(0)) - F.when(changed, 1).otherwise(0)).cast("bigint").alias("duplicates"))


def upsert_totals(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("action") == "added").alias("added"), F.count_if(F.col("action") == "promoted").alias("promoted"),
                      F.sum("duplicates").alias("duplicates"))


def clean_sources(rows: DataFrame, position: str = "position") -> DataFrame:
    """Stored source rows with `seed_urls` as JSON text; first usable row per id wins.

    Text that is no JSON list counts as one URL; rows without a usable URL are dropped.
    """
    listed = F.from_json("seed_urls", "ARRAY<STRING>")
    is_list = F.col("seed_urls").rlike(r"^\s*\[") & F.try_parse_json("seed_urls").isNotNull()
    raw_urls = F.when(F.trim("seed_urls") == "", F.array().cast("array<string>")).when(is_list, listed).otherwise(F.array("seed_urls"))
    urls = F.filter(F.transform(raw_urls, url.source_url), lambda u: u != "")

    def word(name: str, default: str) -> Column:
        return F.coalesce(tx.blank_to_null(F.trim(name)), F.lit(default)).alias(name)

    clean = rows.select(
        position, F.trim("id").alias("id"), F.coalesce(tx.blank_to_null(F.trim("name")), F.trim("id")).alias("name"), urls.alias("seed_urls"),
        word("adapter_mode", "generic"), word("adapter_key", "generic"), word("status", "NEW"),
        F.coalesce(F.nullif(F.col("rate_limit_delay").try_cast("double"), F.lit(0.0)), F.lit(1.0)).alias("rate_limit_delay"),
        tx.as_bool(F.col("enabled"), True).alias("enabled"), tx.as_bool(F.col("include_in_schedule"), False).alias("include_in_schedule"))
    return first_wins(clean.where("id <> '' AND size(seed_urls) > 0"), ["id"], [position])


def runnable_sources(sources: DataFrame, scheduled_only: bool = False) -> DataFrame:
    """Enabled sources with the rule set they run with; `rule` null means no rule set exists for them."""
    known = [r[0] for r in PARSE_RULES]
    wanted = F.coalesce(tx.blank_to_null(F.col("adapter_key")), F.col("id"))
    rule = F.when(F.col("adapter_mode") == "generic", "generic").when(wanted.isin(*known), wanted)
    kept = sources.where("enabled AND include_in_schedule" if scheduled_only else "enabled")
    return kept.withColumn("rule", rule)


def custom_sources(requests: DataFrame, stored: DataFrame, name: str = "name", link: str = "url", position: str = "position") -> DataFrame:
    """User-added sites: generated id, `added` or `duplicate` (URL known without case), enabled only if public.

    A request without a name, over 120 characters, without a URL or with several lines is an error.
    """
    display = tx.squeeze(F.coalesce(F.col(name), F.lit("")))
    given = F.trim(F.coalesce(F.col(link), F.lit("")))
    error = (F.when(display == "", "empty name").when(F.length(display) > 120, "name too long").when(given == "", "empty url")
             .when(given.rlike(r"[\r\n]"), "several urls"))
    staged = requests.select(position, display.alias("name"), url.source_url(given).alias("url"), error.alias("error")).withColumn(
        "_k", F.lower("url"))
    known = stored.select(F.explode("seed_urls").alias("_u")).select(F.lower("_u").alias("_k")).distinct().withColumn("_known", F.lit(True))
    first = staged.where("error IS NULL").groupBy("_k").agg(F.min(position).alias("_first"))
    problem = addresses.url_problem(F.col("url"))
    return staged.join(known, "_k", "left").join(first, "_k", "left").withColumn("_problem", problem).select(
        position, "name", "url",
        F.when(F.col("error").isNotNull(), "error").when(F.col("_known") | (F.col(position) > F.col("_first")), "duplicate").otherwise("added").alias("action"),
        F.coalesce("error", "_problem").alias("message"), ids.custom_source_id(F.col("url")).alias("id"),
        F.col("_problem").isNull().alias("enabled"),
        F.when(F.col("_problem").isNull(), "NEW").otherwise("NEEDS_ADAPTER").alias("status"))


def merge_sources(stored: DataFrame, incoming: DataFrame, keep_if_blank: list[str], always: list[str]) -> DataFrame:
    """Insert or update by id: blank new values keep the old ones in `keep_if_blank`; `always` fields are
    overwritten unless null."""
    old, new = stored.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full")
    pick = [F.coalesce(tx.blank_to_null(F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c) for c in keep_if_blank]
    pick += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in always]
    action = F.when(F.col("o.id").isNull(), "added").when(F.col("n.id").isNull(), "kept").otherwise("updated")
    return joined.select(F.coalesce("n.id", "o.id").alias("id"), action.alias("action"), *pick)


def fold_status(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources after their status events (source_id, status, error, at).

    The last event sets status and error; an error on a generic site disables it; any such error keeps it
    disabled. The last success time is the latest SUCCESS event without error.
    """
    failed = tx.blank_to_null(F.col("error")).isNotNull()
    folded = events.groupBy(F.col("source_id").alias("id")).agg(
        F.max_by(F.struct("status", failed.alias("failed"), "at"), F.struct("at", "status")).alias("last"), F.bool_or(failed).alias("ever_failed"),
        F.max(F.when(~failed & (F.col("status") == "SUCCESS"), F.col("at"))).alias("succeeded_at"))
    generic = F.col("adapter_mode") == "generic"
    off = generic & F.coalesce("ever_failed", F.lit(False))
    return sources.join(folded, "id", "left").withColumns({
        "status": F.when(generic & F.col("last.failed"), "NEEDS_ADAPTER").otherwise(F.coalesce("last.status", "status")),
        "last_error": F.when(F.col("last").isNull(), F.col("last_error")).when(F.col("last.failed"), NOTICE).otherwise(""),
        "last_attempt_at": F.coalesce("last.at", "last_attempt_at"), "last_success_at": F.coalesce("succeeded_at", "last_success_at"),
        "enabled": F.col("enabled") & ~off, "include_in_schedule": F.col("include_in_schedule") & ~off}).drop("last", "ever_failed", "succeeded_at")


def registry_counts(keywords: DataFrame) -> DataFrame:
    return keywords.agg(F.count("*").alias("total"), F.count_if("use_for_filter").alias("filter_total"),
                        F.count_if("use_for_discovery").alias("discovery_total"))
