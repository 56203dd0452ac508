"""Deterministic identifiers: sha-256 over readable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opporta.functions import url


def fingerprint_of_canonical(canonical_url: Column) -> Column:
    return F.sha2(canonical_url, 256)


def fingerprint(raw_url: Column) -> Column:
    """One lead per page: the hash covers the canonical URL only."""
    return fingerprint_of_canonical(url.canonical(raw_url))


def keyed_id(*parts: Column, length: int = 36) -> Column:
    """Hash of the parts joined by `|`; a null part counts as empty."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.left(F.sha2(F.concat_ws("|", *filled), 256), F.lit(length))


def lead_id(canonical_url: Column) -> Column:
    return F.left(fingerprint_of_canonical(canonical_url), F.lit(36))


def custom_source_id(normalized_url: Column) -> Column:
    host_slug = F.left(F.regexp_replace(
        F.regexp_replace(url.host(normalized_url), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(32))
    return F.concat(F.lit("custom-"), F.coalesce(F.nullif(host_slug, F.lit("")), F.lit("website")), F.lit("-"),
                    F.left(F.sha2(normalized_url, 256), F.lit(8)))
