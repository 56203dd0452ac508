"""Phone numbers and contact details in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opporta.functions import let, text as tx

_EXTENSION = r"(?iu)(?:ext\.?|máy\s*lẻ)\s*[:.]?\s*(\d+)"
_PHONE_IN_TEXT = r"(?:\+84|0)(?:[35789]\d{8}|2\d{9})"
_NAME = (
    r"(?iu)(?:liên hệ|người liên hệ|đại diện|cán bộ phụ trách)\s*(?:[:\s]\s*(?:ông|bà)?)?\s*"
    r"([A-ZĐÀ-Ỹa-zđà-ỹ\s]{3,35})(?=[,.\n]|\s+email|\s+sđt|\s+điện thoại|$)"
)


def _one_number(part: Column) -> Column:
    """Domestic form of one number with its extension, or null."""
    digits = F.regexp_replace(F.regexp_replace(part, r"(?s)" + _EXTENSION + r".*$", ""), r"\D", "")
    domestic = let(digits, lambda d: (
        F.when(d.startswith("0084") | d.startswith("84"), F.regexp_replace(d, "^(?:00)?84", "0"))
        .when(d.rlike(r"^(?:[35789]\d{8}|2\d{9})$"), F.concat(F.lit("0"), d))
        .otherwise(d)))
    suffix = let(F.regexp_extract(part, _EXTENSION, 1),
                 lambda x: F.when(x != "", F.concat(F.lit(" máy lẻ "), x)).otherwise(""))
    return let(domestic, lambda n: F.when(n.rlike(r"^(?:0[35789]\d{8}|02\d{9})$"), F.concat(n, suffix)))


def normalize_phones(col: Column) -> Column:
    """`+84 28 3773 1666 (ext. 2245)` -> `02837731666 máy lẻ 2245`; several joined by `; `."""
    return let(F.trim(col), _numbers)


def _numbers(text: Column) -> Column:
    parts = F.split(text, r"(?iu)[,;/\n]+|\s+hoặc\s+")
    numbers = F.array_distinct(F.filter(F.transform(parts, _one_number), lambda n: n.isNotNull()))
    # Cell errors and placeholders.
    usable = (text != "") & ~F.upper(text).isin("#ERROR!", "ERROR", "N/A", "NULL", "NONE")
    return F.when(usable, F.nullif(F.array_join(numbers, "; "), F.lit("")))


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", 0), F.lit(""))


def first_phone(text: Column) -> Column:
    """First phone of the text without blanks, dots and dashes, so digit groups join."""
    joined = F.regexp_replace(text, r"(?U)[\s.-]", "")
    return normalize_phones(F.nullif(F.regexp_extract(joined, _PHONE_IN_TEXT, 0), F.lit("")))


def contact_name(text: Column) -> Column:
    return let(tx.squeeze(F.regexp_extract(text, _NAME, 1)), lambda name: F.when(F.length(name).between(3, 40), name))
