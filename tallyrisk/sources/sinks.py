"""Streaming sinks and checks of what they hold.

All tables use the Parquet file sink: its commit log makes a restarted query exactly-once, and
readers of the directory follow the log. A fresh path per run takes the place of clearing a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def triggered(writer, every: str | None):
    """A processing-time trigger, or drain and stop."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def sink_parquet(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a Parquet table; `every` is a processing-time trigger, None drains and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return triggered(writer.outputMode("append"), every).start()


def alert_messages(scored: DataFrame) -> DataFrame:
    """key and JSON value of every alert, the shape a message topic takes."""
    payload = F.to_json(F.struct("event_id", "score", "label", "produced_at", "scored_at"))
    return scored.filter("is_alert").select(F.col("event_id").cast("string").alias("key"), payload.alias("value"))


def sink_alerts(scored: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Alert messages to JSON files."""
    writer = alert_messages(scored).writeStream.format("json").option("path", path)
    return triggered(writer.option("checkpointLocation", checkpoint).outputMode("append"), every).start()


def sink_alerts_kafka(scored: DataFrame, options: dict[str, str], every: str | None = None) -> StreamingQuery:
    """Alert messages to a Kafka topic. Needs the Kafka connector on the class path."""
    return triggered(alert_messages(scored).writeStream.format("kafka").options(**options), every).start()


def sink_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Rows landed so far; Parquet answers from its footers."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def drain(query: StreamingQuery, timeout_s: float | None = None) -> bool:
    """Wait for a draining query; True when it ended. A failure of the query is raised here."""
    if timeout_s is None:
        query.awaitTermination()
        return True
    return bool(query.awaitTermination(timeout_s))
