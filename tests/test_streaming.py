import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import stream_reports as P
from tallyrisk.plans.stream_queries import SCORED_SCHEMA
from tallyrisk.sources import events as E
from tallyrisk.sources import sinks
from tallyrisk.streaming import score as SC
from tallyrisk.streaming import windows as SW

EDGES, SHARES = [0.0, 0.25, 0.5, 1.0], [0.5, 0.3, 0.2]


def line(i, value, at, label=0):
    return json.dumps({"event_id": i, "features": [value], "produced_at": at, "label": label})


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.250Z"


def scored(spark, incoming, max_files=None):
    events = E.parse_events(E.scan_stream_files(spark, incoming, max_files), width=1)
    return SC.stream_score(events, F.col("features")[0], 0.5)


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp_path, max_files=None):
    paths = SW.FanOutPaths(str(tmp_path / "run"))
    SW.run_fan_out(spark, scored(spark, str(tmp_path / "in"), max_files), paths, "60 seconds", EDGES, SHARES, SCORED_SCHEMA)
    return paths


def windows_of(spark, paths):
    return {r["window_start"].strftime("%M:%S"): r for r in spark.read.parquet(paths.windows).collect()}


def test_fan_out_late_rows_and_flush(spark, tmp_path):
    values = [(i * 7 % 100) / 100 for i in range(180)]
    write_lines(tmp_path / "in", "a.txt", [line(i, v, at(i), int(v > 0.8)) for i, v in enumerate(values)])
    paths = run(spark, tmp_path)
    assert set(windows_of(spark, paths)) == {"00:00", "01:00"}  # the last window is still open
    write_lines(tmp_path / "in", "b.txt", [line(1000 + i, 0.9, at(i)) for i in range(20)])
    paths = run(spark, tmp_path)
    assert spark.read.parquet(paths.scored).count() == 200  # late rows are scored and kept
    assert sum(r["events"] for r in windows_of(spark, paths).values()) == 120  # but change no closed window
    SW.sentinel_line(spark, 1, "2030-01-01T00:00:00.000Z").write.mode("append").text(str(tmp_path / "in"))
    paths = run(spark, tmp_path)
    got = windows_of(spark, paths)
    assert set(got) == {"00:00", "01:00", "02:00"}
    for k, start in enumerate(("00:00", "01:00", "02:00")):
        part = np.array(values[60 * k:60 * k + 60])
        share = np.maximum(np.histogram(part, [-np.inf, 0.25, 0.5, np.inf])[0] / 60, 1e-4)
        psi = float(((share - SHARES) * np.log(share / np.array(SHARES))).sum())
        row = got[start]
        assert (row["events"], row["alerts"]) == (60, int((part >= 0.5).sum()))
        assert row["mean_score"] == pytest.approx(part.mean(), abs=1e-6) and row["score_psi"] == pytest.approx(psi, abs=1e-6)
    alerts = spark.read.schema("key string, value string").json(paths.alerts).collect()
    assert len(alerts) == sum(v >= 0.5 for v in values) + 20
    first = json.loads(min(alerts, key=lambda r: int(r["key"]))["value"])
    assert set(first) == {"event_id", "score", "label", "produced_at", "scored_at"}


def test_several_batches_give_the_same_windows(spark, tmp_path):
    import os

    for k in range(4):
        write_lines(tmp_path / "in", f"{k}.txt", [line(i, 0.3, at(i)) for i in range(45 * k, 45 * k + 45)])
        os.utime(tmp_path / "in" / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    SW.sentinel_line(spark, 1, "2030-01-01T00:00:00.000Z").write.mode("append").text(str(tmp_path / "in"))
    got = windows_of(spark, run(spark, tmp_path, max_files=1))
    assert {k: r["events"] for k, r in got.items()} == {"00:00": 60, "01:00": 60, "02:00": 60}


def test_restart_repeats_nothing(spark, tmp_path):
    write_lines(tmp_path / "in", "a.txt", [line(i, 0.1, at(i)) for i in range(50)])
    run(spark, tmp_path)
    write_lines(tmp_path / "in", "b.txt", [line(i, 0.1, at(i)) for i in range(50, 80)])
    paths = run(spark, tmp_path)
    log = spark.read.parquet(paths.scored)
    assert log.count() == 80 and log.select("event_id").distinct().count() == 80
    assert sinks.sink_row_count(spark, paths.scored).first()[0] == 80


def test_processing_time_trigger(spark, tmp_path):
    write_lines(tmp_path / "in", "a.txt", [line(i, 0.9, at(i)) for i in range(30)])
    query = sinks.sink_parquet(scored(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    try:
        query.processAllAvailable()
        assert not sinks.drain(query, 0.1)  # still running
        assert P.progress_throughput(query) > 0
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 30 and out.select("scored_at").distinct().count() == 1


def test_long_running_fan_out(spark, tmp_path):
    write_lines(tmp_path / "in", "a.txt", [line(i, 0.9, at(i)) for i in range(130)])
    paths = SW.FanOutPaths(str(tmp_path / "run"))
    running = SW.start_fan_out(spark, scored(spark, str(tmp_path / "in")), paths, "60 seconds", EDGES, SHARES, SCORED_SCHEMA)
    try:
        for query in running:
            query.processAllAvailable()
        running[2].processAllAvailable()
    finally:
        for query in running:
            query.stop()
    assert spark.read.parquet(paths.scored).count() == 130
    assert sum(r["events"] for r in windows_of(spark, paths).values()) == 120


def test_malformed_events_go_to_dead_letters(spark):
    bad = ["not json", '{"event_id": 1', line(2, None, at(2)), json.dumps({"event_id": 3, "features": [1.0], "label": 0}),
           line(4, 0.5, "yesterday"), json.dumps({"event_id": 5, "features": [1.0, 2.0], "produced_at": at(5), "label": 1}), ""]
    lines = spark.createDataFrame([(v,) for v in [*bad, line(9, 0.5, at(9), 1)]], "value string")
    assert [r["event_id"] for r in E.parse_events(lines, 1).collect()] == [9]
    assert sorted(r["value"] for r in E.dead_letters(lines, 1).collect()) == sorted(bad)


def test_kafka_options():
    assert E.kafka_options("k:1") == {"kafka.bootstrap.servers": "k:1", "subscribe": "transactions",
                                      "startingOffsets": "earliest", "maxOffsetsPerTrigger": "20000"}
    assert E.kafka_sink_options("k:1", "alerts", "/cp")["topic"] == "alerts"


def test_encode_round_trip_and_pacing(spark):
    df = spark.createDataFrame([(0, 1.23456789, 1), (4000, 2.0, 0)], "id long, v double, y int")
    lines = SW.event_encode(df, ["v"], "id", SW.replay_time("2024-01-01 00:00:00", "id", 2000), "y")
    got = {r["event_id"]: r for r in E.parse_events(lines.select("value"), 1).collect()}
    assert got[0]["features"] == [1.234568] and got[0]["label"] == 1
    assert got[4000]["event_time"] == dt.datetime(2024, 1, 1, 0, 0, 2)
    assert {r["key"] for r in lines.collect()} == {"0", "4000"}


def test_latency_and_lag(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0, t0 + dt.timedelta(milliseconds=10 * i), i % 2 == 0, i % 4 == 0) for i in range(101)]
    df = spark.createDataFrame(rows, "event_id long, produced_at timestamp, scored_at timestamp, is_alert boolean, pos boolean")
    assert tuple(P.latency_percentiles(df).first()) == ("scored_at", 500.0, 950.0, 990.0, 1000.0)
    assert not P.latency_budget(P.latency_percentiles(df), 10).first()["meets_budget"]
    report = P.stream_alert_report(df.withColumn("label", F.col("pos").cast("int"))).first()
    assert (report["alerts"], report["tp"], report["fp"], report["fn"]) == (51, 26, 25, 0)
    lag = P.visible_lag(df).orderBy("sampled_at").collect()
    assert [r["scored"] for r in lag] == list(range(1, 102)) and lag[-1]["visible_lag_s"] == 1.0
    assert P.throughput(df).first()["events_per_second"] == 101.0


def test_empty_alerts_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(False, 0)], "is_alert boolean, label int")
    row = P.stream_alert_report(df).first()
    assert (row["alerts"], row["precision"], row["recall"]) == (0, 0.0, 0.0)


def test_linear_scorer_and_instances(spark):
    model = json.dumps({"weights": [1.0, -2.0], "bias": 0.5}).encode()
    score = SC.score_udf(spark, model, SC.open_linear)
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"b": 1.0}), (3, {})], "id long, named map<string,double>")
    out = SC.score_instances(df, score(SC.instance_array(F.col("named"), ["a", "b"])), 0.5).orderBy("id").collect()
    want = [1 / (1 + np.exp(-z)) for z in (1 - 4 + 0.5, -2 + 0.5, 0.5)]
    assert [r["prediction"]["score"] for r in out] == pytest.approx(want)
    assert [r["prediction"]["fraud"] for r in out] == [False, False, True]


def _onnx_sum_model() -> bytes:
    """A two-node ONNX file (ReduceSum, Sigmoid) written field by field; the onnx package is not here."""

    def varint(n):
        out = b""
        while True:
            out, n = out + bytes([(n & 127) | (128 if n > 127 else 0)]), n >> 7
            if not n:
                return out

    def num(field, n):
        return varint(field << 3) + varint(n)

    def sub(field, body):
        body = body.encode() if isinstance(body, str) else body
        return varint(field << 3 | 2) + varint(len(body)) + body

    def value(name, *dims):
        shape = b"".join(sub(1, sub(2, d) if isinstance(d, str) else num(1, d)) for d in dims)
        return sub(1, name) + sub(2, sub(1, num(1, 1) + sub(2, shape)))

    axes = sub(5, sub(1, "axes") + num(8, 1) + num(20, 7))
    keep = sub(5, sub(1, "keepdims") + num(3, 1) + num(20, 2))
    reduce_ = sub(1, "input") + sub(2, "s") + sub(4, "ReduceSum") + axes + keep
    sigmoid = sub(1, "s") + sub(2, "prob") + sub(4, "Sigmoid")
    graph = sub(1, reduce_) + sub(1, sigmoid) + sub(2, "g") + sub(11, value("input", "n", 2)) + sub(12, value("prob", "n", 1))
    return num(1, 7) + sub(7, graph) + sub(8, sub(1, "") + num(2, 11))


def test_onnx_scorer(spark):
    pytest.importorskip("onnxruntime")
    score = SC.score_udf(spark, _onnx_sum_model(), SC.open_onnx)
    df = spark.createDataFrame([([0.5, 0.25],), ([-1.0, 0.0],)], "x array<double>")
    got = [r[0] for r in df.select(score("x")).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-0.75)), 1 / (1 + np.exp(1.0))], abs=1e-6)


def test_rejected_lines_are_kept(spark, tmp_path):
    good = [line(i, 0.2, at(i)) for i in range(30)]
    bad = ["", "{", good[3][:25], line(40, None, at(1)), json.dumps({"event_id": 9}), line(41, 0.1, "yesterday")]
    write_lines(tmp_path / "in", "a.txt", [*good, *bad])
    paths = SW.FanOutPaths(str(tmp_path / "run"))
    source = str(tmp_path / "in")
    for _ in range(2):  # the second call finds nothing new
        SW.run_fan_out(spark, scored(spark, source), paths, "60 seconds", EDGES, SHARES, SCORED_SCHEMA,
                       rejected=E.dead_letters(E.scan_stream_files(spark, source), width=1))
    assert spark.read.parquet(paths.scored).count() == 30
    assert sorted(r["value"] for r in spark.read.parquet(paths.rejected).collect()) == sorted(bad)


def test_parity_counts_both_sides(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "i int, v string")
    right = spark.createDataFrame([("c", 3), (None, 1), ("d", 4)], "v string, i int")
    row = SW.stream_batch_parity(left, right).first()
    assert (row["compared"], row["only_stream"], row["only_batch"]) == (2, 2, 1)
    assert tuple(SW.stream_batch_parity(left.limit(0), right.limit(0)).first()) == (0, 0, 0)
