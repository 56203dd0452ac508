"""URL expressions. URLs are split by pattern, because `parse_url` rejects blanks and accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opporta.functions import let

# Query parameters that only track the visitor.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


# Plain lower-case host and a path without anything to strip: the common case, returned as it is.
_ALREADY_CANONICAL = r"^https?://[a-z0-9][a-z0-9.\-]*(?::[0-9]+)?(?:/|(?:/[A-Za-z0-9_.~\-]+)+)?$"


def scheme(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, _SCHEME, 1))


def netloc(col: Column) -> Column:
    return F.regexp_extract(col, _PARTS, 1)


def path(col: Column) -> Column:
    return F.regexp_extract(col, _PARTS, 2)


def query(col: Column) -> Column:
    return F.regexp_extract(col, _PARTS, 3)


def host(col: Column) -> Column:
    """Lower-case host without user info, port or brackets."""
    bare = F.regexp_replace(netloc(col), r"^[^@]*@", "")
    return F.lower(F.regexp_replace(bare, r"^\[|\].*$|^([^:\[]*):[^:]*$", "$1"))


def host_key(col: Column) -> Column:
    """Host used to decide whether two URLs belong to one site."""
    return F.regexp_replace(F.regexp_replace(host(col), r"^\.+|\.+$", ""), r"^www\.", "")


def domain(col: Column) -> Column:
    return F.nullif(F.regexp_replace(host(col), r"^www\.", ""), F.lit(""))


def _recode(part: Column) -> Column:
    """Decode one query token the form way, then encode it again with upper-case escapes."""
    decoded = F.try_url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))
    encoded = F.url_encode(decoded)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept_query(raw_query: Column) -> Column:
    """Drop tracking and blank-valued parameters; keep the others in order."""
    pairs = F.filter(F.split(raw_query, "&"), lambda p: p.rlike("^[^=]*=.") )
    names = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    kept = F.filter(pairs, lambda p: ~F.array_contains(
        names, F.lower(F.try_url_decode(F.regexp_replace(
            F.substring_index(p, "=", 1), r"%(?![0-9A-Fa-f]{2})", "%25")))))
    coded = F.transform(kept, lambda p: F.concat(
        _recode(F.substring_index(p, "=", 1)), F.lit("="),
        _recode(F.regexp_replace(p, r"^[^=]*=", ""))))
    return F.array_join(coded, "&")


def canonical(col: Column) -> Column:
    """One spelling per page: lower scheme and host, no tracking, fragment or trailing slash.

    `http` and `https`, and hosts with and without `www.`, stay different.
    """
    return F.coalesce(let(F.trim(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), _canonical_of), F.lit(""))


def _canonical_of(text: Column) -> Column:
    return F.when(text.rlike(_ALREADY_CANONICAL), text).otherwise(_reworked(text))


def _reworked(text: Column) -> Column:
    raw = F.regexp_replace(text, r"""^[*"'`()\[\]<>]+|[*"'`()\[\]<>]+$""", "")
    raw = F.regexp_replace(F.regexp_replace(raw, r"\*+/?$", ""), r"[\t\r\n]", "")
    parts = let(raw, lambda r: F.struct(
        scheme(r).alias("scheme"), netloc(r).alias("netloc"), path(r).alias("path"), query(r).alias("query")))
    return let(parts, lambda p: F.when(p["netloc"].rlike(r"^[^\[]*\]|\[[^\]]*$"), text).otherwise(_rebuilt(p)))


def _rebuilt(p: Column) -> Column:
    def tail(path_text: Column) -> Column:
        params = F.regexp_extract(path_text, r"(;[^/]*)$", 1)
        bare = F.regexp_replace(path_text, r";[^/]*$", "")
        tidy = F.when(F.length(bare) > 1, F.regexp_replace(bare, r"/+$", "")).otherwise(bare)
        return F.concat(tidy, F.when(params == ";", "").otherwise(params))

    def prefixed(value: Column, before: str = "", after: str = "") -> Column:
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")

    place = F.regexp_replace(F.lower(p["netloc"]), r"""[*'"`]+""", "")
    kept = F.when(p["query"] == "", "").otherwise(_kept_query(p["query"]))
    return F.concat(
        prefixed(p["scheme"], after=":"), let(place, lambda h: prefixed(h, before="//")),
        let(p["path"], tail), let(kept, lambda q: prefixed(q, before="?")))


def source_url(col: Column) -> Column:
    """Registry form: `https://` added, host lower-case, path `/` when empty, no fragment."""
    text = F.trim(F.coalesce(col, F.lit("")))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(text == "", "").otherwise(let(full, _registry_form))


def _registry_form(full: Column) -> Column:
    port = F.regexp_extract(F.regexp_replace(netloc(full), r"^.*@", ""), r"(?:^|[^\[:]|\]):(\d+)$", 1)
    raw_path = F.regexp_replace(path(full), r";[^/]*$", "")
    tidy_path = let(raw_path, lambda p: F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, r"/+$", "")))
    rebuilt = F.concat(
        scheme(full), F.lit("://"), host(full),
        let(port, lambda p: F.when(p.rlike("[1-9]"), F.concat(F.lit(":"), p.cast("int").cast("string"))).otherwise("")),
        tidy_path,
        F.when(query(full) != "", F.concat(F.lit("?"), query(full))).otherwise(""))
    return F.when(host(full) == "", full).otherwise(rebuilt)


def root(col: Column) -> Column:
    """Home page of a canonical URL."""
    return let(canonical(col), lambda u: F.concat(scheme(u), F.lit("://"), netloc(u), F.lit("/")))


def without_query(col: Column) -> Column:
    return F.regexp_replace(col, r"[?#].*$", "")


def urls_in_text(col: Column) -> Column:
    """Distinct http(s) URLs in order of appearance, without quoting marks and end punctuation."""
    def cleaned(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
        bare = F.transform(found, lambda u: F.regexp_replace(
            F.regexp_replace(u, r"""[*'"`]+""", ""), r"[.,;:!?)\]}>/]+$", ""))
        return F.array_distinct(F.filter(bare, lambda u: u != ""))

    return F.when(col.contains("://"), cleaned(col)).otherwise(F.array().cast("array<string>"))
