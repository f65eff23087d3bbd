"""Event sources: replayed files, Kafka, Pub/Sub, all with one JSON schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.functions.scalars import ISO_MILLIS

# The event schema and the source limits of the reference job.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("produced_at", T.StringType()), T.StructField("label", T.IntegerType())])
TEXT_SCHEMA = T.StructType([T.StructField("value", T.StringType())])
MAX_OFFSETS_PER_TRIGGER = 20000


def kafka_options(bootstrap: str, topic: str = "transactions", max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": "earliest",
            "maxOffsetsPerTrigger": str(max_offsets)}


def kafka_sink_options(bootstrap: str, topic: str, checkpoint: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic, "checkpointLocation": checkpoint}


def scan_stream_kafka(spark: SparkSession, bootstrap: str, topic: str = "transactions", **limits) -> DataFrame:
    """Text values of a topic. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(bootstrap, topic, **limits)).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def scan_stream_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines of a directory as a text stream, oldest file first; `max_files` caps a micro-batch."""
    reader = spark.readStream.schema(TEXT_SCHEMA).format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parsed(value: Column) -> Column:
    return F.from_json(value, EVENT_SCHEMA, {"mode": "PERMISSIVE"})


def is_complete(width: int | None = None) -> Column:
    """A parsed event is usable when every field is there and no feature is missing."""
    usable = (F.col("event_id").isNotNull() & F.col("features").isNotNull() & F.col("produced_at").isNotNull()
              & F.col("label").isNotNull())
    whole = ~F.exists("features", lambda v: v.isNull())
    if width is not None:
        whole = whole & (F.size("features") == width)
    return F.coalesce(usable & whole, F.lit(False))


def parse_events(lines: DataFrame, width: int | None = None) -> DataFrame:
    """Usable events with `event_time`; everything else is left for `dead_letters`."""
    return (lines.select(parsed(F.col("value")).alias("e")).select("e.*").filter(is_complete(width))
            .withColumn("event_time", F.try_to_timestamp("produced_at", F.lit(ISO_MILLIS)))
            .filter(F.col("event_time").isNotNull()))


def dead_letters(lines: DataFrame, width: int | None = None) -> DataFrame:
    """The lines that `parse_events` rejects."""
    stamp = F.try_to_timestamp("produced_at", F.lit(ISO_MILLIS))
    return (lines.select("value", parsed(F.col("value")).alias("e")).select("value", "e.*")
            .filter(~is_complete(width) | stamp.isNull()).select("value"))


def scan_stream_pubsub(lines: DataFrame, attribute: Column | None = None, delay: str = "0 seconds",
                       unique: Sequence[str] = ()) -> DataFrame:
    """Events whose event time is a message attribute (default: produced_at), with the watermark on it.

    Of messages that agree in the `unique` columns the first is kept and re-sent ones are dropped by state, which the watermark
    clears: `delay` is the time within which a message may come again.
    """
    events = parse_events(lines)
    if attribute is not None:
        events = events.withColumn("event_time", attribute)
    events = events.withWatermark("event_time", delay)
    return events.dropDuplicatesWithinWatermark(list(unique)) if unique else events
