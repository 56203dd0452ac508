"""Text normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Characters that NFKC keeps, beside ASCII; text made only of these stays in the JVM.
NFKC_STABLE = (
    r"¡-§©«¬®°±¶·»¿À-ıĴ-ľŁ-ňŊ-žƠơƯưẠ-ỹ–—‘’“”•₫"
)


@F.pandas_udf(T.StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_batch(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def nfkc(col: Column) -> Column:
    """NFKC; only rows holding a character that could change are sent to Python."""
    # ASCII goes first in one fast sweep; the wide class then sees only what is left.
    unstable = F.regexp_replace(col, r"[\x00-\x7F]+", "").rlike(f"[^{NFKC_STABLE}]")
    return F.when(unstable, _nfkc_batch(F.when(unstable, col))).otherwise(col)


def squeeze(col: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize(col: Column) -> Column:
    """NFKC, single blanks, trimmed; null becomes the empty string."""
    return F.coalesce(squeeze(nfkc(col)), F.lit(""))


def casefold(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def as_bool(col: Column, default: bool) -> Column:
    """Tolerant truth words; empty means the default."""
    value = F.lower(F.trim(col.cast("string")))
    return F.when(F.coalesce(col.cast("string"), F.lit("")) == "", F.lit(default)).otherwise(
        # Words read as true.
        value.isin("true", "1", "yes", "y", "có", "x"))


def slug(col: Column) -> Column:
    """`Chuyển đổi số` -> `chuyen-doi-so`."""
    plain = F.translate(col, "Đđ", "Dd")
    has_marks = plain.rlike(r"[^\x00-\x7F]")
    ascii_only = F.when(has_marks, _ascii_batch(F.when(has_marks, plain))).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contains_any(col: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | col.contains(word)
    return out
