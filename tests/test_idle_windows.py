import json

import numpy as np
from pyspark.sql import functions as F

from tallyrisk.sources import events as E
from tallyrisk.sources import sinks
from tallyrisk.streaming import idle as SI
from tallyrisk.streaming import score as SC
from tallyrisk.streaming import windows as SW

EDGES, SHARES = [0.0, 0.25, 0.5, 1.0], [0.5, 0.3, 0.2]
IDLE_MS = 8000


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    body = [json.dumps({"event_id": i, "features": [v], "produced_at": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.250Z", "label": 0})
            for i, v, s in rows]
    (folder / name).write_text("\n".join(body) + "\n")


def run(spark, tmp_path, idle_ms):
    events = E.parse_events(E.scan_stream_files(spark, str(tmp_path / "in")), width=1)
    scored = SC.stream_score(events, F.col("features")[0], 0.5)
    with SI.timer_state(spark):
        query = sinks.sink_parquet(SI.idle_windows(scored, "60 seconds", EDGES, SHARES, IDLE_MS), str(tmp_path / "out"),
                                   str(tmp_path / "cp"), every="500 milliseconds")
    assert SI.stop_when_idle(query, idle_ms, 120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_idle_windows_close_once_across_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = np.round(rng.random(200), 3).tolist()
    rows = [(i, v, i) for i, v in enumerate(values)]  # windows of 60, 60, 60 and 20 seconds
    write(tmp_path / "in", "a.txt", rows[0::2])
    assert run(spark, tmp_path, 0).count() == 0  # stopped with every window open
    write(tmp_path / "in", "b.txt", rows[1::2])
    got = run(spark, tmp_path, IDLE_MS).orderBy("window_start").toPandas()
    everything = spark.createDataFrame(rows, "event_id long, score double, s long").select(
        "score", (F.col("score") >= 0.5).alias("is_alert"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00.25")).cast("timestamp").alias("t"), "s").select(
        "score", "is_alert", F.timestamp_micros(F.unix_micros("t") + F.col("s") * 1_000_000).alias("produced_at"))
    want = SW.window_stats(everything, "60 seconds", EDGES, SHARES).orderBy("window_start").toPandas()
    assert got["events"].tolist() == [60, 60, 60, 20]
    for column in ("window_start", "window_end", "events", "alerts"):
        assert got[column].tolist() == want[column].tolist()
    assert np.allclose(got["mean_score"], want["mean_score"], atol=1e-6) and np.allclose(got["score_psi"], want["score_psi"], atol=1e-6)
    write(tmp_path / "in", "late.txt", [(900 + i, 0.9, i) for i in range(10)] + [(950, 0.1, 500)])
    after = run(spark, tmp_path, IDLE_MS).orderBy("window_start").toPandas()
    assert after["events"].tolist() == [60, 60, 60, 20, 1]  # closed windows stay as they are, a new one opens and closes


def test_task_sums_take_missing_scores():
    import pandas as pd

    batch = pd.DataFrame({"window_start": [1, 1, 2], "window_end": [2, 2, 3], "score": [0.5, None, 0.25],
                          "is_alert": [True, False, False], "bin": [1, None, 0]})
    out = pd.concat(SI._added_up(2)(iter([batch, batch.iloc[:0], batch])))
    assert out.values.tolist() == [[1, 2, 4, 2, 2, 1.0, [0, 2]], [2, 3, 2, 0, 2, 0.5, [2, 0]]]
    assert list(SI._added_up(2)(iter([])))[0].empty
