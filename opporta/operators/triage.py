"""Time window, one outcome per item, and the counters made of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import dates
from opporta.schemas import SCORE_THRESHOLD

# Fixed values.
WINDOW_DAYS = {"1_day": 1, "1_week": 7, "1_month": 30}
COUNTERS = {
    "new_leads": ["NEW"], "duplicate_leads": ["DUPLICATE"],
    "filtered_out": ["FILTERED_TIME", "FILTERED_KEYWORD", "FILTERED_SCORE"], "error_count": ["ERROR"],
}


def since(timeframe: str | None, now: Column) -> Column | None:
    """Start of a named window, or None for no limit."""
    if not timeframe:
        return None
    if timeframe not in WINDOW_DAYS:
        raise ValueError(f"unknown timeframe: {timeframe}")
    return F.timestamp_add("DAY", F.lit(-WINDOW_DAYS[timeframe]), now)


def local_now(utc_now: Column) -> Column:
    """The cutoff clock is local; crawl times are UTC."""
    return dates.to_local(utc_now)


def with_effective_date(items: DataFrame) -> DataFrame:
    return items.withColumn("effective_at", F.coalesce("published_at", "crawled_at"))


def in_window(items: DataFrame, timeframe: str | None, now: Column) -> DataFrame:
    start = since(timeframe, now)
    dated = with_effective_date(items)
    return dated if start is None else dated.where(F.col("effective_at") >= start)


def triage(items: DataFrame, known: DataFrame, results: DataFrame, timeframe: str | None, now: Column,
           threshold: int = SCORE_THRESHOLD) -> DataFrame:
    """Add `outcome`, decided by the first failing rule.

    items: fingerprint, published_at, crawled_at, is_relevant, ...; known: fingerprint of stored leads;
    results: fingerprint, model_error, score (one row per fingerprint). Repeats inside `items` count as
    duplicates after the first in `position` order, so outcomes partition the input. A first copy that
    fails a rule stores nothing, so the next copy is judged on its own, as a later crawl would.
    """
    start = since(timeframe, now)
    late = F.lit(False) if start is None else F.coalesce(F.col("effective_at") < start, F.lit(True))
    judged = (
        with_effective_date(items)
        .join(known.select("fingerprint", F.lit(True).alias("_known")).distinct(), "fingerprint", "left")
        .join(results.select("fingerprint", "model_error", "score"), "fingerprint", "left")
        .withColumn("outcome", F.when(late, "FILTERED_TIME")
                    .when(F.col("_known"), "DUPLICATE")
                    .when(~F.col("is_relevant"), "FILTERED_KEYWORD")
                    .when(F.col("model_error").isNotNull() | F.col("score").isNull(), "ERROR")
                    .when(F.col("score") < threshold, "FILTERED_SCORE")
                    .otherwise("NEW")).drop("_known"))
    stored = judged.where("outcome = 'NEW'").groupBy("fingerprint").agg(F.min("position").alias("_stored_at"))
    after = F.col("position") > F.col("_stored_at")
    return judged.join(stored, "fingerprint", "left").withColumn(
        "outcome", F.when(after & (F.col("outcome") != "FILTERED_TIME"), "DUPLICATE").otherwise(F.col("outcome"))
    ).drop("_stored_at")


def run_counters(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counters and status of each run; every item is counted once."""
    counts = [F.count_if(F.col("outcome").isin(*names)).alias(counter) for counter, names in COUNTERS.items()]
    return outcomes.groupBy(*keys).agg(F.count("*").alias("total_discovered"), *counts).withColumn(
        "status", run_status(F.col("error_count")))


def run_status(errors: Column, discovery_failed: Column | None = None, stopped: Column | None = None) -> Column:
    """FAILED when discovery failed; PARTIAL with errors or an early stop; else SUCCESS."""
    status = F.when(errors == 0, "SUCCESS").otherwise("PARTIAL")
    if stopped is not None:
        status = F.when(stopped, "PARTIAL").otherwise(status)
    return status if discovery_failed is None else F.when(discovery_failed, "FAILED").otherwise(status)


def job_rollup(runs: DataFrame, key: str = "job_id") -> DataFrame:
    """Status and sums of each job from its runs. The runs stay rows of their own table."""
    bad = F.col("status").isin("FAILED", "PARTIAL")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("total_discovered", *COUNTERS)]
    return runs.groupBy(key).agg(
        F.when(F.bool_and(F.col("status") == "FAILED"), "FAILED").when(F.bool_or(bad), "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.count("*").alias("sources"), *sums)
