"""Structured Streaming: queries over arriving snapshots, append-only sinks, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports
from ..operators.engine import Engine, Query


def snapshot_stream(spark: SparkSession, path: str, schema: str = "url string, content string, content_type string", kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def query_stream(engine: Engine, query: Query, pages: DataFrame) -> DataFrame:
    """Rows of a document query as pages arrive: the batch plan itself, which needs no state."""
    return engine.rows(query, pages)


def write_new(rows: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append rows whose identity isn't stored, batch by batch; a batch that runs again finds its own rows and adds none."""

    def sink(batch: DataFrame, number: int) -> None:
        new = reports.append_to(batch, path)
        if then:
            then(new, number)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(rows: DataFrame, time: str | None = None, within: str = "1 hour") -> DataFrame:
    """Each identity once; with a time column the state is bounded by the watermark."""
    if time:
        return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(["_identity"])
    return rows.dropDuplicates(["_identity"])


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", time: str = "ts", topic: str = "event_type") -> DataFrame:
    """Counts and sums of the event log by window and topic (an extension: the log itself has no windows)."""
    found = events.withWatermark(time, late) if events.isStreaming else events
    out = found.groupBy(F.window(time, every).alias("w"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "topic", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Visits of each key: runs of events with no gap that long (an extension as well)."""
    found = events.withWatermark(time, late) if events.isStreaming else events
    out = found.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
