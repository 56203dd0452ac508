"""Raw documents: identity on disk and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta.functions import ids

SOURCE_FOLDERS = 4  # folders of a day, by source: their number does not grow with sources or pages

# Fixed values.
CHALLENGE_MARKERS = ["cf-chl-", "challenges.cloudflare.com", "just a moment", "verify you are human", "checking your browser"]
PERMANENT_ERRORS = (
    r"network is unreachable|nameresolutionerror|connection refused|getaddrinfo|http (?:400|401|403|404|405|410|422)"
)


def with_snapshot_path(raw: DataFrame) -> DataFrame:
    """Where a page is kept: `source/yyyymmdd/<16 hex of sha256(url)>.html`."""
    return raw.withColumn("snapshot_hash", ids.keyed_id(F.col("url"), length=16)).withColumn(
        "snapshot_day", F.date_format("fetched_at", "yyyyMMdd")).withColumn(
        "snapshot_path", F.concat_ws("/", "source_id", "snapshot_day", F.concat("snapshot_hash", F.lit(".html"))))


def write_raw_documents(raw: DataFrame, path: str) -> None:
    """Parquet by day and source. Days prune scans. The rebalance hint lets adaptive execution merge small
    pieces and split a source that holds a large share of the rows."""
    with_snapshot_path(raw).withColumn("day", F.to_date("fetched_at")).hint("rebalance", "day", "source_id").write.mode("append").partitionBy(
        "day", "source_id").option("maxRecordsPerFile", 500_000).parquet(path)


def write_snapshots(raw: DataFrame, path: str) -> None:
    """Pages as rows of Parquet files in folders by day and source: files follow the bytes, not the number of pages.

    Copies of a page on one day stay rows of their own.
    """
    rows = with_snapshot_path(raw).select("source_id", "snapshot_day", "snapshot_hash", F.coalesce("html", F.lit("")).alias("html"))
    rows.withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(SOURCE_FOLDERS)).cast("int")).hint("rebalance", "snapshot_day", "part").write.mode("append").partitionBy(
        "snapshot_day", "part").option("maxRecordsPerFile", 500_000).parquet(path)


def read_snapshots(spark: SparkSession, path: str, source: str = "*", day: str = "*") -> DataFrame:
    """Whole snapshots: files `path/source/day/hash.html`, identified by their own path, and folders of `write_snapshots`.

    A day (yyyymmdd) or source names folders or rows, so other days are not even listed.
    """
    plain, packed = f"{path}/{source}/{day}/*.html", f"{path}/snapshot_day={day}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def there(pattern: str) -> bool:
        return bool(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)))
    found = spark.createDataFrame([], "html string, source_id string, day string, snapshot_hash string")
    if there(plain):
        name = F.url_decode(F.col("_metadata.file_path"))
        parts = [F.regexp_extract(name, r"([^/]+)/(\d{8})/([0-9a-f]{16})\.html$", k).alias(c) for k, c in ((1, "source_id"), (2, "day"), (3, "snapshot_hash"))]
        found = found.unionByName(spark.read.text(plain, wholetext=True).select(F.col("value").alias("html"), *parts))
    if there(packed):
        rows = spark.read.option("basePath", path).schema("html string, source_id string, snapshot_hash string, snapshot_day string, part int").parquet(packed)
        if source != "*":
            rows = rows.where((F.col("source_id") == source) & (F.col("part") == F.pmod(F.xxhash64(F.lit(source)), F.lit(SOURCE_FOLDERS))))
        found = found.unionByName(rows.select("html", "source_id", F.col("snapshot_day").alias("day"), "snapshot_hash"))
    return found.select("html", "source_id", F.to_date("day", "yyyyMMdd").alias("day"), "snapshot_hash",
                        F.concat_ws("/", "source_id", "day", F.concat("snapshot_hash", F.lit(".html"))).alias("snapshot_path"))


def reject_reason(window: int | None = None) -> Column:
    """Why a fetched page is unusable, or null. A challenge page shows its marker anywhere, or, with a
    `window`, in its first characters."""
    head = F.lower(F.col("html") if window is None else F.left("html", F.lit(window)))
    challenged = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        challenged = challenged | F.contains(head, F.lit(marker))
    kind = F.lower(F.coalesce(F.col("headers")["Content-Type"], F.lit("")))
    return (
        F.when(F.col("status_code") >= 400, "http_error")
        .when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty")
        .when(challenged, "challenge")
        .when((kind != "") & ~kind.rlike("html|xml|text"), "content_type"))


def quality_gate(raw: DataFrame, window: int | None = None) -> DataFrame:
    return raw.withColumn("reject_reason", reject_reason(window))


def too_short(text: Column, least: int = 80) -> Column:
    """A probed page must show at least this many characters of text."""
    return F.length(text) < least


def error_class(message: Column) -> Column:
    """`permanent` errors are not tried again."""
    return F.when(F.lower(message).rlike(PERMANENT_ERRORS), "permanent").otherwise("transient")


def rejects_by_source(gated: DataFrame) -> DataFrame:
    return gated.groupBy("source_id", F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("pages"))
