"""Feeds that are not article pages: job cards, social posts, search answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opporta.functions import addresses, dates, let, once, text as tx, url
from opporta.operators.pages import with_cards
from opporta.rules.link_rules import JOB_URL
from opporta.runtime import cut_lineage


def job_cards(listings: DataFrame, now: Column) -> DataFrame:
    """One row per job URL of the listing pages; the first card of a URL within a page wins."""
    stripped = F.transform(F.col("links"), lambda a: F.struct(
        url.without_query(url.canonical(a["resolved"])).alias("u"), a["text"].alias("t")))
    jobs = F.filter(stripped, lambda a: a["u"].rlike(JOB_URL))
    long_text = F.get(F.filter(F.transform(jobs, lambda a: a["t"]), lambda t: F.length(t) > 3), 0)
    low = F.lower("card_text")

    def ago(unit: str) -> Column:
        return F.nullif(F.regexp_extract(low, rf"(\d{{1,6}})\s*{unit}\s*trước", 1), F.lit("")).cast("int")

    back = (F.when(low.contains("hôm nay"), 0).when(low.contains("hôm qua"), 1)
            .otherwise(F.coalesce(ago("ngày"), ago("tuần") * 7, ago("tháng") * 30, F.lit(0))))
    cards = with_cards(listings).where("parse_error IS NULL").select(
        "listing_url", "position", F.get(jobs, 0)["u"].alias("url"),
        F.coalesce(tx.blank_to_null(F.col("title")), long_text, F.lit("Cơ hội việc làm")).alias("title"),
        F.trim(F.regexp_replace(F.coalesce("company", F.lit("")), r"(?i)^(?:Pro|Vip)\s*", "")).alias("company"),
        F.timestamp_add("DAY", -back, now).alias("published_at"))
    payload = F.struct("position", "title", "company", "published_at")
    return (cards.where("url IS NOT NULL").groupBy("listing_url", "url").agg(F.min(payload).alias("c"))
            .select("listing_url", "url", "c.*"))


def _is_json(text: Column, first: str) -> Column:
    """A JSON object (`{`) or list (`[`); a text that only begins like one is a text."""
    return F.coalesce(text.startswith(first) & F.try_parse_json(text).isNotNull(), F.lit(False))


def _opened(text: Column, *keys: str) -> Column:
    """The keys of a JSON object as text, read in one pass; all null for other text."""
    return F.from_json(text, ", ".join(f"`{k}` STRING" for k in dict.fromkeys(keys)))


def _field(opened: Column, *keys: str) -> Column:
    """First of the keys holding something: not null, not blank, not an empty list or object."""
    values = F.array(*[opened[k] for k in keys])
    return F.get(F.filter(values, lambda v: v.isNotNull() & ~v.isin("", "[]", "{}")), 0)


# Names under which feeds give each fact, in order of preference.
_POST = {
    "url": ("linkedinUrl", "linkedin_url", "postUrl", "post_url", "activityUrl", "activity_url", "url", "link"),
    "text": ("text", "content", "postText", "post_text", "commentary", "description", "summary"),
    "author": ("author", "postedBy", "posted_by", "actor"),
    "name": ("authorName", "author_name", "postedByName"),
    "role": ("authorHeadline", "author_title"),
    "company": ("authorCompany", "companyName", "company_name"),
    "posted": ("postedAt", "posted_at", "publishedAt", "published_at", "postedDate", "posted_date", "date", "timestamp"),
    "title": ("title", "jobTitle", "job_title"),
}
_TEXT = ("text", "content", "description")
_AUTHOR = {
    "name": ("name", "fullName", "full_name", "title"), "role": ("headline", "position", "jobTitle", "job_title"),
    "company": ("company", "companyName", "company_name"),
}


def social_posts(posts: DataFrame, now: Column) -> DataFrame:
    """Posts as JSON text in `body` (and an order column `position`) to items; first post per URL wins.

    Only posts of the network's own site with a non-empty text are kept.
    """
    def facts(opened: Column) -> Column:
        return F.struct(*[_field(opened, *keys).alias(name) for name, keys in _POST.items()])

    def writer(opened: Column) -> Column:
        return F.struct(*[_field(opened, *keys).alias(name) for name, keys in _AUTHOR.items()])

    def text_or(value: Column, *keys: str) -> Column:
        """The text itself, or the first of the keys when it is an object."""
        return F.when(_is_json(value, "{"), let(_opened(value, *keys), lambda o: _field(o, *keys))).otherwise(value)

    def first_of(*values: Column) -> Column:
        return F.coalesce(*[tx.blank_to_null(F.trim(v)) for v in values])

    post = let(_opened(F.col("body"), *[k for ks in _POST.values() for k in ks]), facts)
    read = once(posts, ["position"], p=post).select("position", "p.*")
    named = once(read, read.columns, by=F.when(_is_json(F.col("author"), "{"), let(
        _opened(F.col("author"), *[k for ks in _AUTHOR.values() for k in ks]), writer)))
    epoch = F.when(F.col("posted").rlike(r"^-?\d+(?:\.\d+)?(?:[eE]\d+)?$"), F.col("posted").try_cast("double"))
    micros = let(epoch, lambda e: (F.when(e > 1e10, e / 1000).otherwise(e) * 1e6).cast("bigint"))
    flat = once(
        named, ["position"], url=F.trim("url"), content=text_or(F.col("text"), *_TEXT),
        author=first_of(F.when(~_is_json(F.col("author"), "{"), F.col("author")), F.col("by.name"), F.col("name")),
        author_title=first_of(F.col("by.role"), F.col("role")),
        author_company=first_of(text_or(F.col("by.company"), "name", "title"), F.col("company")),
        published_at=F.when(epoch.isNotNull(), F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), F.timestamp_micros(micros).cast("timestamp_ntz")))
        .otherwise(dates.parse_datetime(F.col("posted"), now)), given_title=F.trim("title"))
    flat = once(flat.withColumn("content", tx.nfkc(F.col("content"))), [c for c in flat.columns if c != "content"],
                content=F.coalesce(tx.squeeze(F.col("content")), F.lit("")))
    kept = flat.where(F.col("url").rlike(r"^https://(?:www\.)?linkedin\.com/") & (F.col("content") != ""))
    first = kept.groupBy("url").agg(F.min_by(F.struct(*[c for c in flat.columns if c != "url"]), "position").alias("p")).select("url", "p.*")
    lines = F.array_compact(F.array(
        F.col("content"), F.concat(F.lit("Tác giả công khai: "), "author"), F.concat(F.lit("Chức danh công khai: "), "author_title"),
        F.concat(F.lit("Đơn vị công khai: "), "author_company")))
    return first.select(
        "url", F.coalesce(tx.blank_to_null(F.col("given_title")), F.left("content", F.lit(220))).alias("title"),
        F.array_join(lines, "\n").alias("raw_content"), "published_at", "author", "author_title", "author_company")


def posted_limit(since: Column, now: Column) -> Column:
    """Coarse search window a social feed understands."""
    age = F.timestamp_diff("SECOND", since, now)
    day = 86400
    return (F.when(age <= day + 300, "24h").when(age <= 8 * day, "week").when(age <= 32 * day, "month").otherwise("year"))


# Names under which search answers give a URL, nested lists, and the texts.
_URL_KEYS = ("url", "link", "href", "source_url", "source", "uri")
_LIST_KEYS = ("results", "items", "links", "data")
_TITLE_KEYS = ("title", "name", "label")
_SNIPPET_KEYS = ("snippet", "content", "description", "summary")
_ANSWER_KEYS = ("text", "content", "answer", "summary")


def _first_url(item: Column, kind: Column, opened: Column) -> Column:
    """First URL under the known keys; an object under a key is looked into one level deep."""
    def inner(text: Column) -> Column:
        return let(_opened(text, *_URL_KEYS), lambda o: F.array(*[o[k] for k in _URL_KEYS]))

    texts = F.flatten(F.transform(F.array(*[opened[k] for k in _URL_KEYS]),
                                  lambda v: F.when(_is_json(v, "{"), inner(v)).otherwise(F.array(v))))
    urls = F.transform(F.when(kind == "object", texts).otherwise(F.array(item)), lambda v: F.get(url.urls_in_text(v), 0))
    return F.get(F.filter(urls, lambda u: u.isNotNull()), 0)


def _text_of(opened: Column, *keys: str) -> Column:
    values = F.transform(F.array(*[opened[k] for k in keys]), lambda v: F.trim(v))
    return F.get(F.filter(values, lambda v: (v != "") & ~_is_json(v, "[") & ~_is_json(v, "{")), 0)


_READ_AHEAD = 3  # levels that are opened in one pass over the answers
_ITEM_KEYS = tuple(dict.fromkeys((*_URL_KEYS, *_LIST_KEYS, *_TITLE_KEYS, *_SNIPPET_KEYS, "published_at", "date")))


def _with_item_fields(items: DataFrame) -> DataFrame:
    """Add `kind` (list, object or text), the known keys `o` and the `found` URL of each item, and whether it `holds` others.

    An item that was read before has them in `old` and is not read again.
    """
    item, new = F.col("item"), F.col("old").isNull()
    keep = [c for c in items.columns if c != "old"]
    known = once(items, [*keep, "old"], kind=F.when(new, F.when(_is_json(item, "["), "list").when(_is_json(item, "{"), "object").otherwise("text")).otherwise(F.col("old.kind")),
                 o=F.when(new, _opened(item, *_ITEM_KEYS)).otherwise(F.col("old.o")))
    full = once(known, [*keep, "kind", "o"], found=F.when(new, _first_url(item, F.col("kind"), F.col("o"))).otherwise(F.col("old.found")))
    return full.withColumn("holds", (F.col("kind") == "list") | ((F.col("kind") == "object") & F.col("found").isNull()))


def _level_opened(items: DataFrame) -> DataFrame:
    """Items that hold others replaced by these: lists by their items, URL-less objects by their known list key. Others stay."""
    nested = F.coalesce(*[F.col(f"o.{k}") for k in _LIST_KEYS])
    members = (F.when(~F.col("holds"), F.array("item")).when(F.col("kind") == "list", F.from_json("item", "ARRAY<STRING>"))
               .when(nested.isNotNull(), F.array(nested)))
    old = F.when(~F.col("holds"), F.struct("kind", "o", "found")).alias("old")
    opened = items.select("query", "answer", "places", old, F.posexplode(members).alias("place", "item"))
    places = F.when(F.col("old").isNull(), F.concat("places", F.array("place"))).otherwise(F.col("places")).alias("places")
    return _with_item_fields(opened.select("query", "answer", "item", places, "old"))


def _open_lists(items: DataFrame) -> DataFrame:
    """Open what holds others until nothing does. Items get `places`: theirs in what held them, from outside in.

    The first levels are opened in the pass that reads the answers; each further pass sees only what is still closed.
    """
    never = F.lit(None).cast(f"struct<kind: string, o: struct<{', '.join(f'`{k}`: string' for k in _ITEM_KEYS)}>, found: string>")
    done, now = None, _with_item_fields(items.withColumns({"places": F.array().cast("array<int>"), "old": never}))
    while True:
        for _ in range(_READ_AHEAD):
            now = _level_opened(now)
        now = cut_lineage(now)
        open_ = now.where("NOT holds")
        done = open_ if done is None else done.unionByName(open_)
        now = now.where("holds")
        if now.isEmpty():
            return done


def search_results(responses: DataFrame, max_results: int | None = None) -> DataFrame:
    """Search answers (`query`, JSON `body`) to rows: position, title, url, snippet, published_at.

    Structured results come first, then URLs named in the answer text; one row per URL; with
    `max_results` only the first of a query are kept; search-engine pages and non-public URLs are dropped after that.
    """
    body = F.trim("body")
    wrapped = F.when(_is_json(body, "["), F.concat(F.lit('{"results":'), body, F.lit("}"))).otherwise(body)
    base = responses.select("query", _opened(wrapped, "results", "answer").alias("d")).select(
        "query", F.col("d.results").alias("item"), F.col("d.answer").alias("given"), _opened(F.col("d.answer"), *_ANSWER_KEYS).alias("a")).select(
        "query", "item", F.coalesce(F.when(_is_json(F.col("given"), "{"), F.trim(_field(F.col("a"), *_ANSWER_KEYS))).otherwise(F.trim("given")), F.lit("")).alias("answer"))
    items = _open_lists(base.where("item IS NOT NULL"))
    opened = F.col("o")
    listed = items.select(
        "query", "answer", F.struct(F.lit(0).alias("stage"), F.col("places").alias("at")).alias("rank"),
        F.col("found").alias("url"), _text_of(opened, *_TITLE_KEYS).alias("title"),
        F.coalesce(_text_of(opened, *_SNIPPET_KEYS), F.lit("")).alias("snippet"),
        F.coalesce(opened["published_at"], opened["date"]).alias("published_at"))
    none = F.lit(None).cast("string")
    named = base.select("query", "answer", F.posexplode(url.urls_in_text(F.col("answer"))).alias("p", "url")).select(
        "query", "answer", F.struct(F.lit(1).alias("stage"), F.array("p").alias("at")).alias("rank"), "url",
        none.alias("title"), F.col("answer").alias("snippet"), none.alias("published_at"))
    payload = F.struct("rank", "url", F.coalesce("title", tx.blank_to_null(url.netloc(F.col("url"))), "url").alias("title"),
                       "snippet", "published_at")
    # One shuffle, by query, serves both numberings.
    every = listed.unionByName(named).where("url IS NOT NULL AND url <> ''").repartition("query")
    unique = every.withColumn("copy", F.row_number().over(W.partitionBy("query", "url").orderBy("rank"))).where("copy = 1").select("query", "answer", payload.alias("r"))
    best = W.partitionBy("query").orderBy("r.rank")
    ranked = unique.withColumn("position", F.row_number().over(best))
    ranked = ranked if max_results is None else ranked.where(F.col("position") <= max_results)
    clean = once(ranked, ["query", "position", "r", "answer"], url=url.canonical(F.col("r.url"))).select(
        "query", "position", F.col("r.title").alias("title"), "url", F.col("r.snippet").alias("snippet"),
        F.col("r.published_at").alias("published_at"), "answer")
    return clean.where((F.col("url") != "") & addresses.url_problem(F.col("url")).isNull() & ~addresses.is_search_engine(F.col("url")))


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in list order, first row per key wins."""
    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    joined = reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [c for c in joined.columns if c not in (key, "_from")]
    picked = joined.groupBy(key).agg(F.min(F.struct("_from", *rest)).alias("f"))
    return picked.select(key, *[F.col(f"f.{c}") for c in rest])
