"""First-wins de-duplication. Aggregates combine on the map side, so a key with a third of all
rows costs one row per task, unlike a window over that key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.functions import ids, url


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by `order` (ties by the other columns)."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(ranked).alias("_f")).select(*keys, *[F.col(f"_f.{c}") for c in rest])


def with_fingerprint(df: DataFrame, raw_url: str = "url") -> DataFrame:
    return df.withColumn("canonical_url", url.canonical(F.col(raw_url))).withColumn(
        "fingerprint", ids.fingerprint_of_canonical(F.col("canonical_url")))


def dedup_urls(feed: DataFrame, order: list[str]) -> DataFrame:
    """One row per canonical URL, with the number of spellings seen."""
    keyed = with_fingerprint(feed)
    rest = [c for c in keyed.columns if c not in ("canonical_url", "fingerprint")]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return keyed.groupBy("canonical_url", "fingerprint").agg(F.min(ranked).alias("_f"), F.count("*").alias("copies")).select(
        "canonical_url", "fingerprint", "copies", *[F.col(f"_f.{c}") for c in rest])


def not_known(items: DataFrame, known: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Items whose key is not stored yet."""
    return items.join(known.select(key), key, "left_anti")


def store_fingerprints(known: DataFrame, table: str, path: str, buckets: int = 256, key: str = "fingerprint") -> None:
    """Write the stored keys as a bucketed table, once per full rebuild. Each bucket is one sorted file."""
    known.select(key).where(F.col(key).isNotNull()).distinct().repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(
        buckets, key).sortBy(key).saveAsTable(table)


def not_stored(items: DataFrame, table: str, order: list[str], key: str = "fingerprint") -> DataFrame:
    """The first item of each key that a bucketed table of `store_fingerprints` lacks.

    The items move once, to the buckets of the table; the stored keys are read where they are, without an exchange.
    """
    return first_wins(items.join(stored_keys(items.sparkSession, table, key), key, "left_anti"), [key], order)


def stored_keys(spark: SparkSession, table: str, key: str = "fingerprint") -> DataFrame:
    """Keys of a bucketed table; never broadcast, for their number grows with all pages ever seen."""
    return spark.table(table).select(key).hint("merge")


def distinct_values(values: Column) -> Column:
    """Stable de-duplication of an array, without nulls and blanks."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != "")))
