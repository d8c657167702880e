"""Streams: files to records, status events to latest states and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ingest import ingest_batch

STUCK = ("parsing", "extracting", "processing", "embedding")


def ingest_stream(files: DataFrame, table_path: str, checkpoint: str, once: bool = True):
    """Start a query that appends new records to ``table_path``; a content hash enters once, restarts repeat nothing.

    With ``once`` all files there are ingested and the query ends (the catch-up at a start).
    """
    spark = files.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        target = f"{table_path}/batch={number}"
        try:
            known = spark.read.parquet(table_path).where(F.col("batch") != number).select("content_hash")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "content_hash string")
        ingest_batch(batch, known, F.current_timestamp()).write.mode("overwrite").parquet(target)  # a repeated batch replaces itself

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def heal(resumes: DataFrame) -> DataFrame:
    """Records left in a working state by a crash become errors."""
    stuck = F.col("status").isin(*STUCK)
    return resumes.withColumn("error", F.when(stuck, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(stuck, "error").otherwise(F.col("status")))


def second_chance(resumes: DataFrame, files: DataFrame) -> DataFrame:
    """Records without the errors whose file is still there: those are read again."""
    retry = resumes.where("status = 'error'").join(files.select("file_path"), "file_path", "left_semi").select("id")
    return resumes.join(retry, "id", "left_anti")


def status_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and tumbling window; on a stream, state is dropped behind the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def debounced(events: DataFrame, key: str, late: str = "1 second") -> DataFrame:
    """One event per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame], mode: str = "append") -> None:
    """Write all that is available of a stream to Parquet and wait."""
    change(stream).writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
