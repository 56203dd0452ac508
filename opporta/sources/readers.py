"""Inputs: raw documents from parquet, registries from YAML, tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta import schemas
from opporta.runtime import spread


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Page tables. Reading HTML is processor work, so a table in few files is spread over all cores."""
    return spread(spark.read.schema(schemas.RAW_DOCUMENTS).parquet(path))


def yaml_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source list of a YAML file as registry cells (`clean_sources` types them)."""
    import json

    import yaml
    with open(path, encoding="utf-8") as file:
        items = (yaml.safe_load(file) or {}).get("sources", [])
    rows = [(i, str(s.get("id") or ""), str(s.get("name") or ""), json.dumps(s.get("seed_urls") or []), "specialized", str(s.get("id") or ""),
             "READY", str(s.get("rate_limit_delay") or ""), str(s.get("enabled", True)), str(s.get("enabled", True))) for i, s in enumerate(items)]
    return spark.createDataFrame(rows, """position INT, id STRING, name STRING, seed_urls STRING, adapter_mode STRING, adapter_key STRING,
        status STRING, rate_limit_delay STRING, enabled STRING, include_in_schedule STRING""")


def yaml_keywords(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(discovery list, groups) of a keyword YAML file, for `seed_keywords`."""
    import yaml
    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file) or {}
    found = [(i, str(k)) for i, k in enumerate(config.get("discovery_search", {}).get("keywords", []))]
    grouped = [(g, str(v.get("name") or g), str(k)) for g, v in config.get("keyword_groups", {}).items() for k in v.get("keywords", [])]
    return (spark.createDataFrame(found, "position INT, keyword STRING"),
            spark.createDataFrame([(i, *row) for i, row in enumerate(grouped)], "position INT, group_id STRING, group_name STRING, keyword STRING"))


def jdbc_table(spark: SparkSession, url: str, table: str, split_on: str | None = None, low: int = 0, high: int = 0, parts: int = 32, **options) -> DataFrame:
    """A database table; with `split_on` it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on:
        reader = reader.options(partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def with_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Additive evolution: missing columns come as null, types are those of the schema."""
    target = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
