"""Streaming ingestion and query-log windows through the same transformations as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import chunk_text, clean_text
from corpusloom.operators.store import upsert
from corpusloom.sources.files import RECORD, record_documents


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    return record_documents(spark.readStream.schema(RECORD).json(folder).withColumn("path", F.col("_metadata.file_path")).where("_corrupt_record is null"))


def ingest(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Cleans, chunks and upserts arriving records into the store at folder; a chunk's id is its source
    and place. A batch taken up again after a crash changes nothing: the store keeps one row a key."""

    def land(batch: DataFrame, number: int) -> None:
        chunks = batch.select("source", "path", F.posexplode(chunk_text(clean_text(F.col("text")))).alias("chunk_id", "chunk"))
        rows = chunks.select(F.concat_ws("_", "source", "chunk_id").alias("id"), "source", "path", "chunk_id", "chunk.*", F.lit(number).alias("version"))
        upsert(batch.sparkSession, folder, rows, "id", "version")

    return records.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, time: str, value: str, *groups: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling hours; on a stream, rows later than the watermark are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    windows = rows.groupBy(F.window(time, "1 hour").alias("w"), *groups).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return windows.select(F.col("w.start").alias("hour"), *groups, "events", "total")
