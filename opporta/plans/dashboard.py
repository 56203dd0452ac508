"""Dashboard numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dashboard_kpis(leads: DataFrame, today: Column) -> DataFrame:
    """All counts, the average score and the budget sum in one pass. `today` is the start of the day."""
    active = F.col("status") != "ARCHIVED"

    def actions(name: str) -> Column:
        return F.count_if(active & (F.col("recommended_action") == name))
    return leads.agg(
        F.count_if(active).alias("total_leads"), actions("CALL").alias("hot_leads"), actions("EMAIL").alias("qualified_leads"),
        actions("NURTURE").alias("nurture_leads"), F.count_if(F.col("status") == "ARCHIVED").alias("archived_leads_count"),
        F.count_if(active & (F.col("crawled_at") >= today)).alias("leads_today"),
        # Half-even at one decimal, on the exact mean.
        F.coalesce(F.bround(F.avg(F.when(active, F.col("score"))), 1), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.sum(F.when(active, F.col("budget_value").cast("decimal(20,2)"))).cast("double"), F.lit(0.0)).alias("total_pipeline_budget"))


def leads_by_source(leads: DataFrame) -> DataFrame:
    """Breakdown of the dashboard: archived leads are left out."""
    return leads.where("status <> 'ARCHIVED'").groupBy("source").agg(F.count("*").alias("leads"))


def source_counts(leads: DataFrame) -> DataFrame:
    """Counts of the source overview: archived leads are included."""
    return leads.groupBy("source").agg(F.count("*").alias("total_leads"), F.count_if(F.col("recommended_action") == "CALL").alias("hot_leads"))


def storage_status(leads: DataFrame, organizations: DataFrame) -> DataFrame:
    return leads.agg(F.count("*").alias("row_count")).select(F.lit("leads").alias("table_name"), "row_count").unionByName(
        organizations.agg(F.count("*").alias("row_count")).select(F.lit("organizations").alias("table_name"), "row_count"))
