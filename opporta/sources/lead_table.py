"""A stored table that is read and changed: hash buckets of the key as partitions, each changed one rewritten whole.

A change reads only the buckets it touches (partition pruning) and replaces only those (dynamic partition overwrite), so
its cost follows the change, and files of other buckets stay as they are. The new content of the touched buckets is written
aside first. If the replacement is interrupted, publishing the same step again finishes it from there, whatever state the
buckets are in; a finished step published again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.operators.dedup import first_wins

BUCKETS = 64
BUCKET = "bucket"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Adaptive execution merges small buckets into one task and splits large ones."""
    rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a new table; `key` must be unique and not null."""
    _write(rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)), path, "errorifexists")


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table as it is now, or some of its buckets; other buckets are not even listed as input."""
    rows = spark.read.parquet(path)
    return rows if only is None else rows.where(F.col(BUCKET).isin(only))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer finished there."""
    files, place = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a step that is no longer needed."""
    files, place = _folder(spark, path)
    files.delete(place, True)


def publish(updates: DataFrame, path: str, key: str, step: str, buckets: int = BUCKETS, keep_known: bool = False) -> int:
    """Insert or replace rows by `key` (unique in `updates`); the number of buckets replaced.

    `step` is the folder of this change, a new one for every change. With `keep_known`, rows whose key is stored are left as
    they are, and only the new ones are added. Columns that updates lack become null.
    """
    spark = updates.sparkSession
    if not is_complete(spark, step):
        # Kept while the step is written: a stream's batch would pass its state once more for each use.
        rows = updates.withColumn(BUCKET, bucket_of(F.col(key), buckets)).persist()
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most `buckets`
        stored = read(spark, path, touched)
        if keep_known:
            fresh = rows.join(stored.select(BUCKET, key), [BUCKET, key], "left_anti")
            # Only buckets with a new key are written again.
            merged = stored.join(fresh.select(BUCKET).distinct(), BUCKET, "left_semi").unionByName(fresh, allowMissingColumns=True)
        else:
            merged = stored.join(rows.select(BUCKET, key), [BUCKET, key], "left_anti").unionByName(rows, allowMissingColumns=True)
        merged.select(*stored.columns).write.mode("overwrite").parquet(step)
        rows.unpersist()
    done = spark.read.schema(spark.read.parquet(path).schema).parquet(step)
    many = done.agg(F.count_distinct(BUCKET)).first()[0]
    if many:
        _write(done, path, "overwrite")
    return many


def publish_new(updates: DataFrame, path: str, key: str, step: str, order: list[str], buckets: int = BUCKETS) -> int:
    """Add the rows whose key is not stored; of several with one key the first by `order`. Rows without a key are left out."""
    return publish(first_wins(updates.where(F.col(key).isNotNull()), [key], order), path, key, step, buckets, keep_known=True)
