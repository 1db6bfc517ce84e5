"""Structured Streaming: files and events as they arrive, the ledger kept up to date, events handed to handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import ledger
from attesta.sources import ledger_store
from attesta.sources.files import artifacts_of
from attesta.sources.snapshots import Snapshots

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files under ``root`` as artifacts; the query's checkpoint remembers what was seen."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    return artifacts_of(files, root)


def once_per_content(artifacts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of the same source and content; the watermark bounds the remembered keys."""
    timed = artifacts.selectExpr("*", "cast(content_created_at AS TIMESTAMP) AS seen_at")
    return timed.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source_uri", "content_hash"])


def event_windows(events: DataFrame, size: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Events per window and type, on a stream or a table (``ts`` is read as UTC)."""
    timed = events.selectExpr("*", "cast(ts AS TIMESTAMP) AS at")
    if timed.isStreaming:
        timed = timed.withWatermark("at", delay)
    from pyspark.sql import functions as F

    return timed.groupBy(F.window("at", size), "change_type").agg(F.count("*").alias("n"))


def ledger_sink(spark: SparkSession, store: Snapshots, as_of: str, rule: ledger.Promotion = ledger.Promotion()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch of arriving claims into the stored ledger.

    Claims, evidence and the batch number are one commit, and only the buckets of the arriving claims are written. A batch that is delivered again changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        done = store.read("batches")
        if done is not None and not done.where(done["batch_id"] == batch_id).isEmpty():
            return
        with store.transaction() as tx:
            ledger_store.merge_in(tx, batch, as_of, rule)
            tx.append("batches", spark.range(1).selectExpr(f"cast({batch_id} AS BIGINT) AS batch_id"))

    return merge


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def watch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Keep watching; the caller stops the query."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
