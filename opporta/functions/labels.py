"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TIMEFRAMES = {"1_day": "24 giờ qua", "1_week": "7 ngày qua", "1_month": "30 ngày qua"}
TRIGGERS = {"FE": "Thủ công từ giao diện", "SCHEDULE": "Tự động theo lịch", "CLI": "Dòng lệnh"}
ALL_SOURCES = "Tất cả các nguồn dữ liệu"
TECHNICAL_MARKERS = ["discovery_failed", "crawl vòng 2", "httpsconnectionpool", "read timed out"]


def mapped(col: Column, labels: dict[str, str]) -> Column:
    """Label of a code; unknown codes show as they are."""
    out = col
    for code, label in labels.items():
        out = F.when(col == code, F.lit(label)).otherwise(out)
    return out


def score_badge(score: Column) -> Column:
    return F.when(score >= 90, "score-hot").when(score >= 80, "score-qualified").otherwise("score-nurture")


def hide_technical(col: Column, own_markers: tuple[str, ...] = ()) -> Column:
    """Null for profile values that are blank or really error messages; `own_markers` are lower-case parts of the
    messages of your own services."""
    low = F.lower(col)
    bad = F.trim(col) == ""
    for marker in (*TECHNICAL_MARKERS, *own_markers):
        bad = bad | low.contains(marker)
    return F.when(~bad, col)
