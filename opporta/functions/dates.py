"""Date parsing with an injected clock, and the local-time view of stored times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opporta.functions import let

# Fixed values.
LABELS = r"^(?:ngày|ngày đăng|thời điểm đăng|cập nhật|hạn đóng thầu|đăng lúc)\s*:\s*"
DATE_VALUE = (
    r"(?i)(?:\d{1,2}:\d{2}(?::\d{2})?\s+\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
    r"|\d{4}-\d{1,2}-\d{1,2}(?:[T\s]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?"
    r"|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?)"
)
NOT_PUBLICATION = (
    r"(?iu)hạn|đóng thầu|mở thầu|hạn chót|deadline|trước ngày|đến ngày|ngày phê duyệt|thời gian thực hiện"
)
LOCAL_ZONE = "Asia/Ho_Chi_Minh"

_ISO = r"^(\d{4})-(\d{2})-(\d{2})t(\d{2}):?(\d{2})(?::?(\d{2}(?:[.,]\d{1,9})?))?(?:z|[+-]\d{2}(?::?\d{2}){0,2})?$"
_TIME_FIRST = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))? (\d{1,2})/(\d{1,2})/(\d{4})$"
_DAY_FIRST = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
_YEAR_DASH = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?$"
_YEAR_SLASH = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
_PLAIN_DAY = r"^\d{1,2}/\d{1,2}/\d{4}\z"
_LOOSE = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:\s+(\d{1,2}):(\d{1,2}))?"


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    whole = [F.coalesce(c.try_cast("int"), F.lit(0)) for c in (year, month, day, hour, minute)]
    seconds = F.coalesce(F.replace(second, F.lit(","), F.lit(".")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    # The stored form has no second 60.
    return let(seconds, lambda s: F.when(s < 60, F.try_make_timestamp_ntz(*whole, s)))


def _groups(text: Column, pattern: str, *order: int) -> Column:
    pick = [F.regexp_extract(text, pattern, g) if g else F.lit("0") for g in order]
    return F.when(text.rlike(pattern), _stamp(*pick))


def parse_datetime(text: Column, now: Column) -> Column:
    """Timestamp without zone from ISO, relative or Vietnamese date text; null when unreadable.

    ISO text keeps its own wall clock: the zone is dropped. `text` should be normalized.
    """
    return let(F.when(text != "", F.lower(text)), lambda low: F.when(low.rlike(_PLAIN_DAY), _plain_day(low)).otherwise(F.coalesce(
        F.when(low.contains("t"), _groups(F.trim(low), _ISO, 1, 2, 3, 4, 5, 6)),
        _relative(low, now),
        let(F.trim(F.regexp_replace(low, LABELS, "")), _absolute))))


def _plain_day(text: Column) -> Column:
    """The most frequent form, a day alone (d/m/yyyy), without the search for any other."""
    parts = F.substring_index(text, "/", 1), F.substring_index(F.substring_index(text, "/", 2), "/", -1), F.substring_index(text, "/", -1)
    day, month, year = (part.try_cast("int") for part in parts)
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))


def _relative(low: Column, now: Column) -> Column:
    def ago(unit: str) -> Column:
        return -F.regexp_extract(low, rf"(\d{{1,9}})\s*{unit}\s*trước", 1).try_cast("int")
    return (
        F.when(low.contains("vừa xong") | low.contains("vừa đăng"), now)
        .when(low.rlike(r"\d\s*giờ\s*trước"), F.timestamp_add("HOUR", ago("giờ"), now))
        .when(low.rlike(r"\d\s*ngày\s*trước"), F.timestamp_add("DAY", ago("ngày"), now))
        .when(low.contains("hôm qua"), now - F.expr("INTERVAL '1' DAY")))


def _absolute(body: Column) -> Column:
    return F.when(body.rlike(r"\d{4}"), F.coalesce(
        _groups(body, _TIME_FIRST, 6, 5, 4, 1, 2, 3),
        _groups(body, _DAY_FIRST, 4, 3, 1, 5, 6, 7),
        _groups(body, _YEAR_DASH, 1, 2, 3, 4, 5, 6),
        _groups(body, _YEAR_SLASH, 1, 2, 3, 0, 0, 0),
        _groups(body, _LOOSE, 3, 2, 1, 4, 5, 0)))


def published_candidate(text: Column, now: Column) -> Column:
    """Date of a text that does not speak of a deadline or another event."""
    return let(text, lambda t: F.when((t != "") & ~t.rlike(NOT_PUBLICATION), parse_datetime(
        F.coalesce(F.nullif(F.regexp_extract(t, DATE_VALUE, 0), F.lit("")), t), now)))


def iso_or_null(text: Column) -> Column:
    """Strict ISO date or date-time of a sheet cell, zone dropped."""
    day = r"^(\d{4})-(\d{2})-(\d{2})$"
    return let(F.lower(F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})[ T]", "$1t")), lambda low: F.coalesce(
        _groups(low, _ISO, 1, 2, 3, 4, 5, 6), _groups(low, day, 1, 2, 3, 0, 0, 0)))


def to_local(ts: Column) -> Column:
    """Stored UTC wall clock shown in local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts)
