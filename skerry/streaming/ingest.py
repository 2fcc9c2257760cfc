"""Streams: rows appended to a columnar table batch by batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(stream: DataFrame, table: str, checkpoint: str, columns: list[str]) -> StreamingQuery:
    """All that is there now, in one run; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds the state of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
