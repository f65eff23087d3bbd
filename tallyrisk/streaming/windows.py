"""Event encoding, windowed score statistics and the one-pass fan-out of a scored stream."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import feature_array, iso_millis
from tallyrisk.operators.drift import histogram_columns, histogram_psi
from tallyrisk.sources.sinks import drain, sink_alerts, sink_parquet

# Id of the event that only moves the watermark, partitions of the window state.
SENTINEL_ID = -1
STATE_PARTITIONS = 4


def event_encode(df: DataFrame, features: Sequence[str], event_id: str, produced_at: Column, label: str) -> DataFrame:
    """key and JSON value per row; features rounded to six decimals."""
    body = F.struct(F.col(event_id).alias("event_id"), feature_array(features, 6).alias("features"),
                    iso_millis(produced_at).alias("produced_at"), F.col(label).cast("int").alias("label"))
    return df.select(F.col(event_id).cast("string").alias("key"), F.to_json(body).alias("value"))


def replay_time(start: str, seq: str, rate: float) -> Column:
    """start + seq / rate seconds: the send time of a paced replay as a column."""
    micros = F.unix_micros(F.to_timestamp(F.lit(start))) + F.floor(F.col(seq) * F.lit(1e6 / rate))
    return F.timestamp_micros(micros)


def window_stats(scored: DataFrame, width: str = "60 seconds", edges: Sequence[float] | None = None,
                 reference: Sequence[float] | None = None, time: str = "produced_at") -> DataFrame:
    """Tumbling windows: events, alerts, mean_score and, with a reference, score_psi.

    Count, alert count, score sum and the histogram are plain aggregates of one grouping, so a stream
    keeps only a few numbers per open window and each task combines before the exchange. A window
    without events gives no row.
    """
    grouped = scored.groupBy(F.window(time, width).alias("w"))
    bins = histogram_columns(F.col("score"), edges) if edges else []
    stats = grouped.agg(F.count(F.lit(1)).alias("events"), F.count_if("is_alert").alias("alerts"),
                        F.avg("score").alias("mean"), *bins)
    psi = [F.round(histogram_psi(F.col("events"), reference), 6).alias("score_psi")] if edges else []
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "alerts",
                        F.round("mean", 6).alias("mean_score"), *psi)


def window_counts(scored: DataFrame, width: str, edges: Sequence[float], time: str = "produced_at") -> DataFrame:
    """What `window_stats` adds up, one row a window: parts of a window from several batches are merged by `merged_windows`."""
    rows = scored.groupBy(F.window(time, width).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_alert").alias("alerts"), F.count("score").alias("scored"),
        F.sum("score").alias("score_sum"), *histogram_columns(F.col("score"), edges))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rows.columns[1:])


def merged_windows(counts: DataFrame, reference: Sequence[float]) -> DataFrame:
    """`window_counts` of any number of batches as the columns of `window_stats`."""
    sums = ["events", "alerts", "scored", "score_sum", *[f"bin_{i}" for i in range(len(reference))]]
    merged = counts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in sums])
    return merged.select("window_start", "window_end", "events", "alerts", F.round(F.try_divide("score_sum", "scored"), 6).alias("mean_score"),
                         F.round(histogram_psi(F.col("events"), reference), 6).alias("score_psi"))


def streaming_windows(scored: DataFrame, width: str, edges: Sequence[float], reference: Sequence[float],
                      delay: str = "0 seconds") -> DataFrame:
    """`window_stats` on a stream: rows for windows the watermark has passed, late rows dropped."""
    marked = scored.withWatermark("produced_at", delay)
    return window_stats(marked, width, edges, reference).withColumn("emitted_at", F.current_timestamp())


def sentinel_line(spark: SparkSession, width: int, stamp: str) -> DataFrame:
    """One event far in the future that closes every real window; its own window stays open."""
    return spark.range(1).select(F.to_json(F.struct(
        F.lit(SENTINEL_ID).cast("long").alias("event_id"),
        F.array_repeat(F.lit(0.0), width).alias("features"),
        F.lit(stamp).alias("produced_at"), F.lit(0).alias("label"))).alias("value"))


@contextmanager
def small_state(spark: SparkSession, partitions: int = STATE_PARTITIONS):
    """Start a stateful query with few state partitions: a window's state is a handful of numbers.

    The number is fixed by the first checkpoint, whatever the batch shuffles of the session use.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@dataclass(frozen=True)
class FanOutPaths:
    """Where one run keeps its scored log, alerts, windows and checkpoints."""

    root: str

    @property
    def scored(self) -> str:
        return f"{self.root}/scored"

    @property
    def alerts(self) -> str:
        return f"{self.root}/alerts"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rejected"

    @property
    def windows(self) -> str:
        return f"{self.root}/windows"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def run_fan_out(spark: SparkSession, scored: DataFrame, paths: FanOutPaths, width: str, edges: Sequence[float],
                reference: Sequence[float], schema, max_files: int | None = None, rejected: DataFrame | None = None) -> None:
    """Drain what is available: score once into the log, then derive alerts and windows from the log.

    `rejected` is the stream of lines that could not be parsed (`dead_letters` of the same source); they go to a table of
    their own, so that lines in are rows scored plus rows rejected. Called again with the same paths it goes on from the
    checkpoints.
    """
    drain(sink_parquet(scored, paths.scored, paths.checkpoint("scored")))
    if rejected is not None:
        drain(sink_parquet(rejected, paths.rejected, paths.checkpoint("rejected")))

    def log() -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(paths.scored)

    real = F.col("event_id") != SENTINEL_ID
    with small_state(spark):
        followers = [sink_alerts(log().filter(real), paths.alerts, paths.checkpoint("alerts")),
                     sink_parquet(streaming_windows(log(), width, edges, reference), paths.windows,
                                  paths.checkpoint("windows"))]
    for query in followers:
        drain(query)


def start_fan_out(spark: SparkSession, scored: DataFrame, paths: FanOutPaths, width: str, edges: Sequence[float],
                  reference: Sequence[float], schema, every: str = "1 second", rejected: DataFrame | None = None):
    """The same queries as long-running ones on a processing-time trigger."""
    log = sink_parquet(scored, paths.scored, paths.checkpoint("scored"), every)
    letters = [] if rejected is None else [sink_parquet(rejected, paths.rejected, paths.checkpoint("rejected"), every)]
    tail = spark.readStream.schema(schema).parquet(paths.scored)
    with small_state(spark):
        return [log, sink_alerts(tail, paths.alerts, paths.checkpoint("alerts"), every),
                sink_parquet(streaming_windows(tail, width, edges, reference), paths.windows,
                             paths.checkpoint("windows"), every), *letters]


def stream_batch_parity(streamed: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: rows that both sides hold, and rows that only the stream and only the batch holds.

    Equal rows of both sides meet in one aggregation of all columns, as a count for and a count against.
    """
    sides = streamed.withColumn("_side", F.lit(1)).unionByName(batch.select(*streamed.columns).withColumn("_side", F.lit(-1)))
    counted = sides.groupBy(*streamed.columns).agg(F.count_if(F.col("_side") > 0).alias("s"), F.count_if(F.col("_side") < 0).alias("b"))
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (
        ("compared", F.least("s", "b")), ("only_stream", F.greatest(F.col("s") - F.col("b"), F.lit(0))),
        ("only_batch", F.greatest(F.col("b") - F.col("s"), F.lit(0))))])

