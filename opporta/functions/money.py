"""Vietnamese money amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opporta.functions import let

_UNIT = r"(?:\s*(?:đồng|vnđ|vnd|đ))?"
_END = r"(?![\p{L}\p{N}_])"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def currency(col: Column, compat: bool = False) -> Column:
    """struct(value, matched): the first amount found, largest unit pattern first.

    A comma or dot before a unit is a decimal mark. By default the unit must end at a word
    boundary; `compat=True` drops that, so that `10 tin` reads as ten billion.
    """
    return let(col, lambda text: _first_amount(text, "" if compat else _END))


def _first_amount(text: Column, end: str) -> Column:
    both = rf"(?iu)(\d+(?:[.,]\d+)?)\s*t[ỷi]\s*(\d+(?:[.,]\d+)?)\s*tri[ệe]u"
    billions = rf"(?iu)(\d+(?:[.,]\d+)?)\s*t[ỷi]{end}{_UNIT}"
    millions = rf"(?iu)(\d+(?:[.,]\d+)?)\s*(?:tri[ệe]u|tr){end}{_UNIT}"
    grouped = rf"(?iu)(\d{{1,3}}(?:[.,]\d{{3}}){{2,}}){_UNIT}"

    def hit(pattern: str, value: Callable[[Callable[[int], Column]], Column]) -> Column:
        """The text is searched once; groups are read from what matched, which is short."""
        return let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", F.struct(
            value(lambda group: F.regexp_extract(m, pattern, group)).alias("value"), m.alias("matched"))))

    return F.coalesce(
        hit(both, lambda part: _number(part(1)) * 1e9 + _number(part(2)) * 1e6),
        hit(billions, lambda part: _number(part(1)) * 1e9),
        hit(millions, lambda part: _number(part(1)) * 1e6),
        hit(grouped, lambda part: F.regexp_replace(part(1), "[.,]", "").try_cast("double")),
    )


def money_label(value: Column, thousands: str = ".") -> Column:
    """Display form: `1,5 tỷ VNĐ`, `300 triệu VNĐ`, `950.000 VNĐ`; null when not positive.

    Rounded half up as doubles, like SQL's `round`: 1.025 is a little less than it shows, so it gives 1,02.
    """

    def localized(number: Column, decimals: int) -> Column:
        scale = float(10 ** decimals)
        shown = F.format_number(F.round(number * scale) / scale, decimals)
        if decimals:
            shown = F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")
        return F.replace(F.translate(shown, ".,", ",."), F.lit("."), F.lit(thousands))

    return (F.when(value >= 1e9, F.concat(localized(value / 1e9, 2), F.lit(" tỷ VNĐ")))
            .when(value >= 1e6, F.concat(localized(value / 1e6, 1), F.lit(" triệu VNĐ")))
            .when(value > 0, F.concat(localized(value, 0), F.lit(" VNĐ"))))
