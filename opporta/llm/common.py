"""Shared pieces of the training-data operators: stored steps, row results, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import weakref

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opporta import runtime


BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep what a Python worker gets at once small: documents are long, and a batch of the usual 10,000 is not.

    Lowers the session's Arrow batch limits; lower ones that the caller has set stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


_kept: dict = {}


def worker_state(owner: str, key, make):
    """What a Python worker keeps from task to task for one operator. Another operator's, or another key's, goes."""
    if (owner, key) not in _kept:
        _emptied()
        _kept[(owner, key)] = make()
    return _kept[(owner, key)]


def _emptied() -> None:
    """Drop what the worker keeps and give the memory back: Spark uses a worker again, and others wait beside it."""
    if _kept:
        _kept.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return what the worker has freed to the system; its allocators would keep it beside the JVM and the other workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the checkpoint folder, which the driver and all executors reach."""
    runtime.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a step once and read it back: later steps neither repeat it nor depend on its lineage."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def forget(*steps: DataFrame) -> None:
    """Delete the files of `stored` steps. Nothing that is still to be computed may read them."""
    for step in steps:
        spark = step.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(step))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with names that stay the same: place in the file for a scan of files, else a number that is written with the row."""
    file, at = free_name(docs, "row_file"), free_name(docs, "row_at")
    try:
        return docs.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")}), [file, at]
    except AnalysisException:
        return stored(docs.withColumns({file: F.lit(0).cast("bigint"), at: F.monotonically_increasing_id()}), "numbered"), [file, at]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def masks(chosen: DataFrame, row: list[str]) -> DataFrame:
    """Rows named as in `numbered`, as a bit each: `row_file, row_block, row_mask`, the mask for 64 rows of a file that follow each other."""
    file, at = row
    return chosen.groupBy(F.col(file).alias("row_file"), F.shiftright(at, 6).alias("row_block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{at}` & 63 as int))")).alias("row_mask"))


def masked(rows: DataFrame, row: list[str], chosen: DataFrame) -> DataFrame:
    """The numbered rows that `masks` has, with their columns.

    The masks of some ten million rows are few enough for Spark to send to the rows; beyond that both are dealt out.
    """
    file, at = (F.col(f"`{x}`") for x in row)
    named = [free_name(rows, x) for x in ("mask_file", "mask_block", "mask")]
    return rows.join(chosen.toDF(*named), (file == F.col(named[0])) & (F.shiftright(at, 6) == F.col(named[1])) & (F.getbit(named[2], (at % 64).cast("int")) == 1)).drop(*named)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of `edges(a, b)` reaches, as `node, root`; self-loops are allowed.

    Alternates large-star and small-star rounds. Minima are map-side combined and joined back, so a hub is no
    single task; each round is checkpointed.
    """
    pair = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = runtime.cut_lineage(edges.select(*pair).where("lo < hi").distinct())
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(
            F.struct("m", F.col("lo").alias("x")), F.struct("m", F.col("hi").alias("x")))).alias("e")).select(F.col("e.m").alias("lo"), F.col("e.x").alias("hi"))
        now = runtime.cut_lineage(small.where("lo < hi").distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    leaves = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return leaves.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
