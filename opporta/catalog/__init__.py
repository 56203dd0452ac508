"""Queries over the given tables, one per operator, each with the SQL that checks it.

The tables are no leads or pages, so each query first derives its input from them: the same SELECT
text runs in Spark and in the checking engine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opporta import runtime

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str, tables: dict[str, str]) -> str:
    """Fill `{table}`, `{v_view}` and `{TS}` places; other braces stay."""
    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name in tables:
            return tables[name]
        return f"({expand(VIEWS[name], tables)})" if name in VIEWS else match.group(0)
    return re.sub(r"\{(\w+)\}", fill, sql)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, spread: str = "") -> DataFrame:
    """Run a SELECT over the tables; those named in `spread` feed costly per-row work."""
    places = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    for table in spread.split():
        view = f"opporta_{table}_{zlib.crc32(sf_dir.encode())}"
        runtime.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).createOrReplaceTempView(view)
        places[table] = view
    return spark.sql(expand(sql, {**places, "TS": "TIMESTAMP_NTZ"}))


def oracle(sql: str) -> str:
    return expand(sql, {**{t: t for t in TABLES}, "TS": "TIMESTAMP"})


def query(name: str, check: str | None = None):
    """Register a query; `check` is its oracle."""
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = oracle(check)
        return fn
    return add
