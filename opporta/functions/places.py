"""Provinces and cities named in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions.terms import with_term_hits

# The first name in this order wins, wherever it stands in the text.
PROVINCES = [
    "Hà Nội", "Hồ Chí Minh", "TP.HCM", "TP. Hồ Chí Minh", "Đà Nẵng", "Hải Phòng", "Cần Thơ",
    "An Giang", "Bà Rịa - Vũng Tàu", "Bắc Giang", "Bắc Kạn", "Bạc Liêu", "Bắc Ninh",
    "Bến Tre", "Bình Định", "Bình Dương", "Bình Phước", "Bình Thuận", "Cà Mau",
    "Cao Bằng", "Đắk Lắk", "Đắk Nông", "Điện Biên", "Đồng Nai", "Đồng Tháp",
    "Gia Lai", "Hà Giang", "Hà Nam", "Hà Tĩnh", "Hải Dương", "Hậu Giang",
    "Hòa Bình", "Hưng Yên", "Khánh Hòa", "Kiên Giang", "Kon Tum", "Lai Châu",
    "Lâm Đồng", "Lạng Sơn", "Lào Cai", "Long An", "Nam Định", "Nghệ An",
    "Ninh Bình", "Ninh Thuận", "Phú Thọ", "Phú Yên", "Quảng Bình", "Quảng Nam",
    "Quảng Ngãi", "Quảng Ninh", "Quảng Trị", "Sóc Trăng", "Sơn La", "Tây Ninh",
    "Thái Bình", "Thái Nguyên", "Thanh Hóa", "Thừa Thiên Huế", "Tiền Giang",
    "Trà Vinh", "Tuyên Quang", "Vĩnh Long", "Vĩnh Phúc", "Yên Bái",
]


def listed_place(place: Column, names: list[str] = PROVINCES) -> Column:
    """Name at a position of the list; the long forms of TP.HCM are merged."""
    name = F.get(F.array(*map(F.lit, names)), place)
    return F.when(name.isin("Hồ Chí Minh", "TP. Hồ Chí Minh"), "TP.HCM").otherwise(name)


def with_location(df: DataFrame, text: Column, out: str, names: list[str] = PROVINCES) -> DataFrame:
    """Add the first listed place of the text."""
    hits = f"_{out}_hits"
    return with_term_hits(df, text, names, hits).withColumn(out, listed_place(F.array_min(F.col(hits)), names)).drop(hits)
