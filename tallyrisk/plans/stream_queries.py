"""Registered streaming queries: every one reads what real streaming runs over `events` have landed."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.functions.scalars import iso_millis
from tallyrisk.landing import fresh_path, land
from tallyrisk.operators import drift as D
from tallyrisk.operators import joins as J
from tallyrisk.operators import stream_reports as P
from tallyrisk.operators.report import beside
from tallyrisk.operators.split import split_points
from tallyrisk.plans import workload as W
from tallyrisk.plans.registry import query
from tallyrisk.plans.sql_parts import EV, iso
from tallyrisk.sources import epochs as EP
from tallyrisk.sources import events as E
from tallyrisk.sources import sinks
from tallyrisk.sources import topic_log as T_LOG
from tallyrisk.streaming import idle as SI
from tallyrisk.streaming import score as SC
from tallyrisk.streaming import windows as SW

# Window length of the replay, the closing event's time, the late re-sends, and the silence that closes a window.
WIDTH = "1 day"
FAR_FUTURE = "2100-01-01T00:00:00.000Z"
LATE_BEFORE = "2024-01-06 00:00:00"
IDLE_MS = 10_000

SCORED_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("is_alert", T.BooleanType()), T.StructField("label", T.IntegerType()),
    T.StructField("produced_at", T.TimestampType()), T.StructField("scored_at", T.TimestampType())])

_REFERENCE = """
ref_rows AS (SELECT score AS s FROM ev, (SELECT floor(count(*)*CAST(0.7 AS DOUBLE)) AS c1,
    floor(count(*)*(CAST(0.7 AS DOUBLE)+CAST(0.1 AS DOUBLE))) AS c2 FROM events) WHERE event_id >= c1 AND event_id < c2),
q AS (SELECT list_sort(list_distinct(quantile_cont(s, [CASE WHEN i=10 THEN 1e0 ELSE i*1e-1 END FOR i IN range(11)]))) AS e
      FROM ref_rows)"""


def reference(spark, sf_dir) -> tuple[list[float], list[float]]:
    """Edges and proportions of the validation slice's scores; eleven and ten numbers at most."""
    ev = W.events(spark, sf_dir)
    low, high = split_points(ev.count())
    row = D.psi_reference(ev.filter((F.col("event_id") >= low) & (F.col("event_id") < high))).first()
    return list(row["edges"]), list(row["reference"])


def event_lines(spark, sf_dir):
    lines = SW.event_encode(W.events(spark, sf_dir), ["value"], "event_id", F.col("ts"), "label")
    return lines.select("value")


def damaged_lines(spark, sf_dir):
    """A line cut off after 20 characters for every 50th event."""
    return event_lines(spark, sf_dir).filter(F.get_json_object("value", "$.event_id").cast("long") % 50 == 0).select(
        F.substring("value", 1, 20).alias("value"))


def scored_stream(spark, incoming: str, max_files: int | None = None):
    events = E.parse_events(E.scan_stream_files(spark, incoming, max_files), width=1)
    return SC.stream_score(events, W.event_score(F.col("features")[0]), W.EVENT_THRESHOLD)


def rejected_stream(spark, incoming: str):
    return E.dead_letters(E.scan_stream_files(spark, incoming, None), width=1)


def replay(spark, sf_dir) -> SW.FanOutPaths:
    """One whole run: all events, then late re-sends, then the closing event, resumed in between."""
    return _replay(spark, spark.sparkContext.applicationId, sf_dir)


@cache
def _replay(spark, _application: str, sf_dir: str) -> SW.FanOutPaths:
    paths = SW.FanOutPaths(fresh_path(spark, "replay"))
    incoming = f"{paths.root}/incoming"
    edges, shares = reference(spark, sf_dir)
    late = W.events(spark, sf_dir).filter(F.col("ts") < F.lit(LATE_BEFORE).cast("timestamp"))
    late = late.withColumn("event_id", -F.col("event_id") - 2)
    steps = [event_lines(spark, sf_dir).unionByName(damaged_lines(spark, sf_dir)),
             SW.event_encode(late, ["value"], "event_id", F.col("ts"), "label").select("value"),
             SW.sentinel_line(spark, 1, FAR_FUTURE)]
    for lines in steps:
        lines.write.mode("append").text(incoming)
        SW.run_fan_out(spark, scored_stream(spark, incoming), paths, WIDTH, edges, shares, SCORED_SCHEMA,
                       rejected=rejected_stream(spark, incoming))
    return paths


def scored_log(spark, sf_dir):
    """The scored log without late re-sends and the closing event."""
    return spark.read.schema(SCORED_SCHEMA).parquet(replay(spark, sf_dir).scored).filter(F.col("event_id") >= 0)


def windows_table(spark, sf_dir):
    return spark.read.parquet(replay(spark, sf_dir).windows)


def _shown(df):
    return df.select(iso_millis(F.col("window_start")).alias("window_start"),
                     iso_millis(F.col("window_end")).alias("window_end"), "events", "alerts", "mean_score")


_SCORED = "SELECT event_id, label, is_alert, round(score, 6) AS score, " + iso("produced") + " AS produced_at FROM ev"
_DAYS = """days AS (SELECT date_trunc('day', produced) AS d, count(*) AS events, count(*) FILTER (is_alert) AS alerts,
  round(avg(score), 6) AS mean_score FROM ev GROUP BY 1)"""
_WINDOWS = f"""SELECT {iso('CAST(d AS TIMESTAMP)')} AS window_start, {iso('CAST(d AS TIMESTAMP) + INTERVAL 1 DAY')} AS window_end,
  events, alerts, mean_score FROM days"""


def _scored_view(df):
    return df.select("event_id", "label", "is_alert", F.round("score", 6).alias("score"),
                     iso_millis(F.col("produced_at")).alias("produced_at"))


@query("scan_stream_files", f"WITH {EV} SELECT event_id, label, round(value, 6) AS feature, {iso('produced')} AS produced_at FROM ev")
def _(spark, sf_dir):
    """Text files to parsed events through a draining stream."""
    root = fresh_path(spark, "files")
    event_lines(spark, sf_dir).write.text(f"{root}/incoming")
    parsed = E.parse_events(E.scan_stream_files(spark, f"{root}/incoming", max_files=4), width=1)
    out = parsed.select("event_id", "label", F.round(F.col("features")[0], 6).alias("feature"), "produced_at")
    sinks.drain(sinks.sink_parquet(out, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out")


@query("scan_stream_pubsub_resent", f"WITH {EV} SELECT event_id, label, {iso('produced')} AS produced_at, 1 AS times FROM ev")
def _(spark, sf_dir):
    """Every third message comes twice, in another batch or after a restart; state drops it inside the watermark."""
    root = fresh_path(spark, "resent")
    lines = event_lines(spark, sf_dir)
    again = lines.filter(F.get_json_object("value", "$.event_id").cast("long") % 3 == 0)
    for delivery in (lines, again):
        delivery.write.mode("append").text(f"{root}/incoming")
        events = E.scan_stream_pubsub(E.scan_stream_files(spark, f"{root}/incoming", max_files=4), delay="60 days", unique=["event_id"])
        sinks.drain(sinks.sink_parquet(events.select("event_id", "label", "produced_at"), f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").groupBy("event_id", "label", "produced_at").agg(F.count(F.lit(1)).cast("int").alias("times"))


def _topic_of_events(spark, sf_dir, root, part):
    """Append the even or odd events to the topic, keyed by their id."""
    half = W.events(spark, sf_dir).filter(F.pmod("event_id", F.lit(2)) == part)
    lines = SW.event_encode(half, ["value"], "event_id", F.col("ts"), "label")
    keyed = lines.select(F.get_json_object("value", "$.event_id").alias("key"), "value")
    T_LOG.append_topic(keyed, f"{root}/transactions")


@query("scan_stream_kafka", f"""WITH {EV} SELECT event_id, label, round(value, 6) AS feature, {iso('produced')} AS produced_at,
  1 AS times_read, true AS within_limit FROM ev""")
def _(spark, sf_dir):
    """A partitioned log read in limited batches; half of it is appended between a stop and a restart from the checkpoint."""
    root = fresh_path(spark, "topic")
    most = []
    for part in (0, 1):
        _topic_of_events(spark, sf_dir, root, part)
        lines = T_LOG.scan_topic(spark, f"{root}/transactions", max_offsets=E.MAX_OFFSETS_PER_TRIGGER, checkpoint=f"{root}/checkpoint")
        events = E.parse_events(lines.select("value"), width=1)
        out = events.select("event_id", "label", F.round(F.col("features")[0], 6).alias("feature"), "produced_at")
        most += T_LOG.caught_up(sinks.sink_parquet(out, f"{root}/out", f"{root}/checkpoint", every="0 seconds"))
    landed = spark.read.parquet(f"{root}/out")
    return landed.groupBy("event_id", "label", "feature", "produced_at").agg(F.count(F.lit(1)).cast("int").alias("times_read")).withColumn(
        "within_limit", F.lit(max(most, default=0) <= E.MAX_OFFSETS_PER_TRIGGER))


@query("sink_alerts_kafka", f"""WITH {EV} SELECT CAST(event_id AS VARCHAR) AS key, event_id, round(score, 6) AS score, label,
  {iso('produced')} AS produced_at FROM ev WHERE is_alert""")
def _(spark, sf_dir):
    """Alerts of a scored topic appended to a topic of their own, which is then read as a stream."""
    root = fresh_path(spark, "alert-topic")
    for part in (0, 1):
        _topic_of_events(spark, sf_dir, root, part)
    events = E.parse_events(T_LOG.scan_topic(spark, f"{root}/transactions").select("value"), width=1)
    scored = SC.stream_score(events, W.event_score(F.col("features")[0]), W.EVENT_THRESHOLD)
    T_LOG.caught_up(T_LOG.sink_topic(sinks.alert_messages(scored), f"{root}/alerts", f"{root}/alerts-checkpoint", "alerts"))
    back = T_LOG.scan_topic(spark, f"{root}/alerts").select("key", "value")
    T_LOG.caught_up(sinks.sink_parquet(back, f"{root}/out", f"{root}/checkpoint", every="0 seconds"))
    body = F.from_json("value", "event_id long, score double, label int, produced_at timestamp, scored_at timestamp")
    return spark.read.schema("key string, value string").parquet(f"{root}/out").select("key", body.alias("b")).select(
        "key", "b.event_id", F.round("b.score", 6).alias("score"), "b.label", iso_millis(F.col("b.produced_at")).alias("produced_at"))


@query("scan_stream_pubsub", f"""WITH {EV} SELECT event_id, {iso("date_trunc('minute', produced)")} AS event_minute FROM ev""")
def _(spark, sf_dir):
    """The event time comes from an attribute beside the payload and carries the watermark."""
    root = fresh_path(spark, "attribute")
    event_lines(spark, sf_dir).write.text(f"{root}/incoming")
    stamped = E.scan_stream_pubsub(E.scan_stream_files(spark, f"{root}/incoming"),
                                   F.date_trunc("minute", F.to_timestamp("produced_at")))
    out = stamped.select("event_id", iso_millis(F.col("event_time")).alias("event_minute"))
    sinks.drain(sinks.sink_parquet(out, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out")


@query("stream_score", f"WITH {EV} {_SCORED}")
def _(spark, sf_dir):
    return _scored_view(scored_log(spark, sf_dir))


@query("sink_parquet", f"WITH {EV} SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, CAST(sum(label) AS BIGINT) AS labels FROM ev")
def _(spark, sf_dir):
    return scored_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"),
                                         F.sum("label").alias("labels"))


@query("sink_alerts", f"""WITH {EV} SELECT CAST(event_id AS VARCHAR) AS key, event_id, round(score, 6) AS score, label,
  {iso('produced')} AS produced_at FROM ev WHERE is_alert""")
def _(spark, sf_dir):
    messages = spark.read.schema("key string, value string").json(replay(spark, sf_dir).alerts)
    body = F.from_json("value", "event_id long, score double, label int, produced_at timestamp, scored_at timestamp")
    return messages.select("key", body.alias("b")).filter("b.event_id >= 0").select(
        "key", "b.event_id", F.round("b.score", 6).alias("score"), "b.label", iso_millis(F.col("b.produced_at")).alias("produced_at"))


@query("sink_append_tables", f"""WITH {EV} SELECT 'scores' AS name, count(*) AS rows FROM ev
  UNION ALL SELECT 'windows', count(DISTINCT date_trunc('day', produced)) FROM ev""")
def _(spark, sf_dir):
    tables = {"scores": scored_log(spark, sf_dir), "windows": windows_table(spark, sf_dir)}
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return counts[0].unionByName(counts[1])


@query("sink_append_epochs", f"""WITH {EV}, {_DAYS} SELECT {iso('CAST(d AS TIMESTAMP)')} AS window_start, events, alerts, mean_score,
  events AS scored_rows FROM days""")
def _(spark, sf_dir):
    """Scores and window sums committed together, half of the events after a restart; both tables are read as of one epoch."""
    root = fresh_path(spark, "epochs")
    edges, shares = reference(spark, sf_dir)
    halves = W.events(spark, sf_dir).withColumn("part", F.col("event_id") % 2)
    for part in (0, 1):
        half = SW.event_encode(halves.filter(F.col("part") == part), ["value"], "event_id", F.col("ts"), "label")
        half.select("value").write.mode("append").text(f"{root}/incoming")
        sinks.drain(EP.sink_append_tables(
            scored_stream(spark, f"{root}/incoming", max_files=8), f"{root}/tables", f"{root}/checkpoint",
            lambda batch: {"scores": batch, "windows": SW.window_counts(batch, WIDTH, edges)}))
    sums = "window_start timestamp, window_end timestamp, events long, alerts long, scored long, score_sum double, " + ", ".join(
        f"bin_{i} long" for i in range(len(shares)))
    tables = EP.read_tables(spark, f"{root}/tables", {"scores": SCORED_SCHEMA, "windows": sums})
    days = tables["scores"].groupBy(F.date_trunc("day", "produced_at").alias("window_start")).agg(F.count(F.lit(1)).alias("scored_rows"))
    return SW.merged_windows(tables["windows"], shares).join(days, "window_start").select(
        iso_millis(F.col("window_start")).alias("window_start"), "events", "alerts", "mean_score", "scored_rows")


@query("stream_fanout", f"""WITH {EV} SELECT count(*) AS scored, count(*) FILTER (is_alert) AS alerts, count(*) AS in_windows,
  count(*) FILTER (is_alert) AS window_alerts FROM ev""")
def _(spark, sf_dir):
    """Scored log, alerts and windows of one run must reconcile."""
    paths = replay(spark, sf_dir)
    scored = scored_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("scored"))
    body = F.from_json("value", "event_id long")
    alerts = spark.read.schema("value string").json(paths.alerts).select(body.alias("b")).filter("b.event_id >= 0") \
        .agg(F.count(F.lit(1)).alias("alerts"))
    held = windows_table(spark, sf_dir).agg(F.sum("events").alias("in_windows"), F.sum("alerts").alias("window_alerts"))
    return beside(scored, alerts, held)


@query("tumbling_score_stats", f"WITH {EV}, {_DAYS} {_WINDOWS}")
def _(spark, sf_dir):
    return _shown(windows_table(spark, sf_dir))


@query("late_drop", f"WITH {EV}, {_DAYS} {_WINDOWS}")
def _(spark, sf_dir):
    """The run sends the first days again after their windows closed: no window may change or repeat."""
    late = spark.read.schema(SCORED_SCHEMA).parquet(replay(spark, sf_dir).scored).filter("event_id < -1").count()
    if late == 0:
        raise AssertionError("the replay sent no late events")
    return _shown(windows_table(spark, sf_dir))


@query("window_flush", f"WITH {EV}, {_DAYS} SELECT count(*) AS windows, CAST(sum(events) AS BIGINT) AS events FROM days")
def _(spark, sf_dir):
    """The closing event emits every real window and none of its own."""
    return windows_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("windows"), F.sum("events").alias("events"))


@query("window_flush_idle", f"WITH {EV}, {_DAYS} {_WINDOWS}")
def _(spark, sf_dir):
    """Windows that close by a timer after ten idle seconds, with no closing event; half of the events come after a restart."""
    root = fresh_path(spark, "idle")
    edges, shares = reference(spark, sf_dir)
    halves = W.events(spark, sf_dir).withColumn("part", F.col("event_id") % 2)
    for part, idle_ms in ((0, 0), (1, IDLE_MS)):
        half = SW.event_encode(halves.filter(F.col("part") == part), ["value"], "event_id", F.col("ts"), "label")
        half.select("value").write.mode("append").text(f"{root}/incoming")
        with SI.timer_state(spark):
            windows = SI.idle_windows(scored_stream(spark, f"{root}/incoming"), WIDTH, edges, shares, IDLE_MS)
            running = sinks.sink_parquet(windows, f"{root}/out", f"{root}/checkpoint", every="500 milliseconds")
        if not SI.stop_when_idle(running, idle_ms):
            raise AssertionError("the windows did not close in time")
    return _shown(spark.read.parquet(f"{root}/out"))


_PSI_SQL = f"""WITH {EV}, {_REFERENCE},
  c AS (SELECT unnest(range(len(e)-1)) AS bin FROM q),
  r AS (SELECT c.bin, greatest(count(s)/CAST((SELECT count(*) FROM ref_rows) AS DOUBLE), 1e-4) AS share
        FROM c LEFT JOIN (SELECT s, len(list_filter(e[2:len(e)-1], lambda x: x <= s)) AS bin FROM ref_rows, q) b USING (bin) GROUP BY c.bin),
  w AS (SELECT date_trunc('day', produced) AS d, len(list_filter(e[2:len(e)-1], lambda x: x <= score)) AS bin FROM ev, q),
  n AS (SELECT d, count(*) AS total FROM w GROUP BY d),
  h AS (SELECT n.d, c.bin, greatest(count(w.bin)/CAST(any_value(total) AS DOUBLE), 1e-4) AS share FROM n CROSS JOIN c
        LEFT JOIN w ON w.d = n.d AND w.bin = c.bin GROUP BY n.d, c.bin)
  SELECT {iso('CAST(d AS TIMESTAMP)')} AS window_start, round(sum((h.share-r.share)*ln(h.share/r.share)), 6) AS score_psi
  FROM h JOIN r USING (bin) GROUP BY d"""


@query("tumbling_score_psi", _PSI_SQL)
def _(spark, sf_dir):
    return windows_table(spark, sf_dir).select(iso_millis(F.col("window_start")).alias("window_start"), "score_psi")


@query("window_stats_udaf", _PSI_SQL)
def _(spark, sf_dir):
    """The same statistics as a batch aggregate: partial and final aggregation are Spark's."""
    edges, shares = reference(spark, sf_dir)
    batch = W.events(spark, sf_dir).withColumn("produced_at", F.date_trunc("millisecond", "ts")) \
        .withColumn("is_alert", F.col("score") >= W.EVENT_THRESHOLD)
    return SW.window_stats(batch, WIDTH, edges, shares).select(
        iso_millis(F.col("window_start")).alias("window_start"), "score_psi")


@query("stream_batch_parity", f"WITH {EV} SELECT count(*) AS compared, 0::BIGINT AS only_stream, 0::BIGINT AS only_batch FROM ev")
def _(spark, sf_dir):
    """All rows of the stream's output, against the same scoring as a batch job."""
    batch = W.events(spark, sf_dir).select(
        "event_id", "score", (F.col("score") >= W.EVENT_THRESHOLD).alias("is_alert"), "label",
        F.date_trunc("millisecond", "ts").alias("produced_at"))
    return SW.stream_batch_parity(scored_log(spark, sf_dir).drop("scored_at"), batch)


@query("restart_from_checkpoint", f"WITH {EV} SELECT count(*) AS rows, count(*) AS ids, 0 AS duplicates FROM ev")
def _(spark, sf_dir):
    """A run in two halves: the second starts from the first one's checkpoint and repeats nothing."""
    root = fresh_path(spark, "restart")
    incoming = f"{root}/incoming"
    halves = W.events(spark, sf_dir).withColumn("part", F.col("event_id") % 2)
    for part in (0, 1):
        half = SW.event_encode(halves.filter(F.col("part") == part), ["value"], "event_id", F.col("ts"), "label")
        half.select("value").write.mode("append").text(incoming)
        sinks.drain(sinks.sink_parquet(scored_stream(spark, incoming, max_files=8), f"{root}/out", f"{root}/checkpoint"))
    return J.duplicate_count(spark.read.parquet(f"{root}/out"), "event_id")


@query("stream_drain", f"WITH {EV} SELECT count(*) AS events, true AS ended FROM ev")
def _(spark, sf_dir):
    """A draining run ends by itself within its timeout and has scored everything."""
    root = fresh_path(spark, "drain")
    event_lines(spark, sf_dir).write.text(f"{root}/incoming")
    ended = sinks.drain(sinks.sink_parquet(scored_stream(spark, f"{root}/incoming"), f"{root}/out", f"{root}/checkpoint"), 300)
    return spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("events"), F.lit(ended).alias("ended"))


@query("stream_latency", f"""WITH {EV} SELECT 'written_at' AS stamp, true AS ordered, count(*) AS events FROM ev
  UNION ALL SELECT 'scored_at', true, count(*) FROM ev""")
def _(spark, sf_dir):
    """Latency to the batch start and to the write of the scored log; percentiles must be in order."""
    written = F.col("_metadata.file_modification_time").alias("written_at")
    log = spark.read.schema(SCORED_SCHEMA).parquet(replay(spark, sf_dir).scored).select("*", written).filter("event_id >= 0")
    found = P.latency_percentiles(log, ["scored_at", "written_at"])
    ordered = (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("p99_ms")) & (F.col("p99_ms") <= F.col("max_ms"))
    events = log.agg(F.count(F.lit(1)).alias("events"))
    count = events.first()["events"]
    return found.select("stamp", ordered.alias("ordered"), F.lit(count).alias("events"))


@query("score_udf", f"""WITH {EV} SELECT event_id, round(1e0/(1e0+exp(-(value*1e-2 - 2e0))), 6) AS score FROM ev""")
def _(spark, sf_dir):
    """A broadcast model file scored in Arrow batches."""
    model = json.dumps({"weights": [0.01], "bias": -2.0}).encode()
    score = SC.score_udf(spark, model, SC.open_linear)
    events = E.parse_events(event_lines(spark, sf_dir), width=1)
    return events.select("event_id", F.round(score("features"), 6).alias("score"))


@query("event_batching", f"""WITH {EV} SELECT count(*) AS events, round(sum(1e0/(1e0+exp(-(value*1e-2 - 2e0)))), 4) AS total,
  true AS within_limit, true AS no_early_call FROM ev""")
def _(spark, sf_dir):
    """Events that reach Python 16 at a time: calls of 64 to 2,000 rows, unless the first row has waited long enough or input ends."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = json.dumps({"weights": [0.01], "bias": -2.0}).encode()
    SC.set_event_batching(spark, 16)
    try:
        calls = SC.score_batched(E.parse_events(event_lines(spark, sf_dir), width=1).select("event_id", "features"), model, SC.open_linear)
        calls = land(calls.select("score", "call_rows", "call_waited_s", "call_last"), "calls")  # while the setting holds
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    large = (F.col("call_rows") >= SC.LEAST_ROWS) | F.col("call_last") | (F.col("call_waited_s") >= SC.WAIT_SECONDS)
    return calls.agg(F.count("score").alias("events"), F.round(F.sum("score"), 4).alias("total"),
                     F.bool_and(F.col("call_rows") <= SC.ARROW_BATCH).alias("within_limit"), F.bool_and(large).alias("no_early_call"))


@query("score_instances", f"""WITH {EV} SELECT event_id, round(v/(v+100e0), 6) AS score,
    v/(v+100e0) >= CAST({W.EVENT_THRESHOLD} AS DOUBLE) AS fraud
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE value END AS v FROM ev)""")
def _(spark, sf_dir):
    """Named instances: a third of them lack the feature, which then counts 0.0."""
    named = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("other"), F.col("value"))).otherwise(
        F.create_map(F.lit("value"), F.col("value")))
    x = SC.instance_array(named, ["value"])
    found = SC.score_instances(W.events(spark, sf_dir), W.event_score(x[0]), W.EVENT_THRESHOLD)
    return found.select("event_id", F.round("prediction.score", 6).alias("score"), "prediction.fraud")


@query("micro_batch_trigger", f"WITH {EV} SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, true AS stayed_up FROM ev")
def _(spark, sf_dir):
    """A processing-time query takes in what is there and keeps running until it is stopped."""
    root = fresh_path(spark, "trigger")
    event_lines(spark, sf_dir).write.text(f"{root}/incoming")
    running = sinks.sink_parquet(scored_stream(spark, f"{root}/incoming"), f"{root}/out", f"{root}/checkpoint", every="1 second")
    try:
        running.processAllAvailable()
        up = running.isActive
    finally:
        running.stop()
    return spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"),
                                                 F.lit(up).alias("stayed_up"))


@query("sink_reset", f"WITH {EV} SELECT run, count(*) AS rows FROM ev, (VALUES (1), (2)) v(run) GROUP BY run")
def _(spark, sf_dir):
    """A run starts on a fresh path, so the second holds no row of the first."""
    counts = []
    for number in (1, 2):
        root = fresh_path(spark, "reset")
        event_lines(spark, sf_dir).write.text(f"{root}/incoming")
        sinks.drain(sinks.sink_parquet(scored_stream(spark, f"{root}/incoming"), f"{root}/out", f"{root}/checkpoint"))
        counts.append(sinks.sink_row_count(spark, f"{root}/out").select(F.lit(number).alias("run"), "rows"))
    return counts[0].unionByName(counts[1])


@query("rejected_lines", f"WITH {EV} SELECT count(*) AS lines, 20 AS longest FROM ev WHERE event_id % 50 = 0")
def _(spark, sf_dir):
    """Lines that the stream could not parse, in their own table beside the scored log."""
    letters = spark.read.schema("value string").parquet(replay(spark, sf_dir).rejected)
    return letters.agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("value")).alias("longest"))
