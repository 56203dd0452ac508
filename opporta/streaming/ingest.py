"""Continuous ingest: new documents to a table, each page once.

What was seen is one fingerprint per page in the query's state, which RocksDB keeps on disk and saves as changes; what was
written is in the file sink's log. A batch therefore reads its own documents only, however many pages are stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opporta.operators.dedup import with_fingerprint
from opporta.operators.match import match_keywords
from opporta.sources import lead_table

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Use RocksDB for the state of streams started after this."""
    spark.conf.set(*STATE_STORE)


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup_stream(documents: DataFrame, time: str = "fetched_at", delay: str | None = None) -> DataFrame:
    """The first document of each page that arrives. With `delay`, pages older than that behind the newest
    are forgotten, so that the state stays small and a later copy is taken for new."""
    keyed = with_fingerprint(documents)
    if delay is None:
        return keyed.dropDuplicates(["fingerprint"])
    return keyed.withColumn(time, keyed[time].cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages of finished batches; the sink's log leaves out what a failed batch wrote."""
    return spark.read.parquet(path)


def start_ingest(documents: DataFrame, path: str, checkpoint: str, available_now: bool = True, delay: str | None = None):
    writer = dedup_stream(documents, delay=delay).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def match_batches(read_keywords: Callable[[], DataFrame], item_id: str, sink: Callable[[DataFrame, int], None]):
    """foreachBatch writer that matches keywords with the registry as it is when the batch starts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sink(match_keywords(batch, read_keywords(), item_id), batch_id)
    return write


def lead_batches(path: str, steps: str, key: str, order: list[str], buckets: int = lead_table.BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that adds leads whose key the stored table lacks.

    A batch that runs again, in part or whole, leaves the same table: its step folder is named by its number. The folder of
    the batch before goes, for a batch only starts when the one before is committed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        lead_table.publish_new(batch, path, key, f"{steps}/{batch_id}", order, buckets)
        lead_table.forget(batch.sparkSession, f"{steps}/{batch_id - 1}")
    return write


def start_lead_ingest(leads: DataFrame, path: str, checkpoint: str, order: list[str], key: str = "content_fingerprint", time: str = "crawled_at",
                      delay: str | None = None, buckets: int = lead_table.BUCKETS, available_now: bool = True):
    """Leads from a stream into the stored table at `path`: copies inside the stream, then known leads, are left out.

    With `delay`, copies within that time of each other are dropped before the batch is formed; others meet the stored table.
    """
    if delay is not None:
        at = "_event_time"
        leads = leads.withColumn(at, leads[time].cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key]).drop(at)
    writer = leads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lead_batches(path, f"{checkpoint}/steps", key, order, buckets))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
