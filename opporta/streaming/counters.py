"""Windowed counters of outcomes and run sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.operators.triage import COUNTERS


def outcome_counters(outcomes: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counters per source and tumbling window. The same expression works on a batch and on a stream."""
    counts = [F.count_if(F.col("outcome").isin(*names)).alias(counter) for counter, names in COUNTERS.items()]
    stamped = outcomes.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark(time, late).groupBy("source", F.window(time, window).alias("w")).agg(F.count("*").alias("total_discovered"), *counts)
    return grouped.select("source", F.col("w.start").alias("window_start"), "total_discovered", *COUNTERS)


def run_sessions(outcomes: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs per source as sessions: a pause longer than `gap` ends a run."""
    stamped = outcomes.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark(time, late).groupBy("source", F.session_window(time, gap).alias("s")).agg(
        F.count("*").alias("items"), F.count_if(F.col("outcome") == "ERROR").alias("errors"))
    return grouped.select("source", F.col("s.start").alias("run_start"), F.col("s.end").alias("run_end"), "items", "errors")
