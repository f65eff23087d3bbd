import json
import os

import pytest
from pyspark.sql import functions as F

from tallyrisk.sources import topic_log as T
from tallyrisk.sources.sinks import sink_parquet


def messages(spark, low, high, keyed=True):
    rows = spark.range(low, high, 1, 3).select(F.col("id").cast("string").alias("value"))
    return rows.withColumn("key", F.expr("concat('k', value % 7)")) if keyed else rows


def read(spark, root, name, max_offsets=None, starting="earliest"):
    """One run of a reader until it has caught up: the rows of its batches."""
    checkpoint = f"{root}/{name}-checkpoint"
    stream = T.scan_topic(spark, f"{root}/topic", starting, max_offsets, checkpoint)
    return T.caught_up(sink_parquet(stream, f"{root}/{name}", checkpoint, every="0 seconds"))


def test_restart_reads_on_within_the_limit(spark, tmp_path):
    root = str(tmp_path)
    T.append_topic(messages(spark, 0, 250), f"{root}/topic", 4)
    first = read(spark, root, "a", 60)
    T.append_topic(messages(spark, 250, 400, keyed=False), f"{root}/topic", 4)
    second = read(spark, root, "a", 60)
    assert sum(first) == 250 and sum(second) == 150 and max(first + second) <= 60 and len(first) >= 5
    rows = spark.read.parquet(f"{root}/a").collect()
    assert sorted(int(r["value"]) for r in rows) == list(range(400))
    for p in range(4):
        assert sorted(r["offset"] for r in rows if r["partition"] == p) == list(range(sum(r["partition"] == p for r in rows)))
    # A key keeps to one partition, and its messages to their order within an append's task.
    assert all(len({r["partition"] for r in rows if r["key"] == f"k{i}"}) == 1 for i in range(7))
    assert read(spark, root, "a", 60) == []


def test_latest_starts_behind_what_is_there(spark, tmp_path):
    root = str(tmp_path)
    T.append_topic(messages(spark, 0, 30), f"{root}/topic", 2)
    assert read(spark, root, "b", starting="latest") == []
    T.append_topic(messages(spark, 30, 50), f"{root}/topic", 2)
    assert sum(read(spark, root, "b", starting="latest")) == 20
    assert sorted(int(r["value"]) for r in spark.read.parquet(f"{root}/b").collect()) == list(range(30, 50))


def test_a_repeated_range_gives_the_same_messages(spark, tmp_path):
    topic = f"{tmp_path}/topic"
    for low in (0, 40, 41):
        T.append_topic(messages(spark, low, max(low + 1, 40)), topic, 3)
    reader = T.TopicReader({"path": f"file://{topic}"})
    end = reader.latestOffset()
    half = {p: e // 2 for p, e in end.items()}
    assert reader.initialOffset() == {p: 0 for p in end} and sum(end.values()) == 42

    def values(start, stop):
        return [v for s in reader.partitions(start, stop) for b in reader.read(s) for v in zip(b["partition"].to_pylist(), b["offset"].to_pylist(), b["value"].to_pylist())]

    assert values(half, end) == values(half, end) and sorted(values({p: 0 for p in end}, half) + values(half, end)) == sorted(values({}, end))
    assert values(end, end) == []


def test_a_stream_appends_a_repeated_batch_once(spark, tmp_path):
    root = str(tmp_path)
    T.append_topic(messages(spark, 0, 90), f"{root}/topic", 2)
    out = T.scan_topic(spark, f"{root}/topic")
    query = T.sink_topic(out.select("key", F.concat("value", F.lit("!")).alias("value")), f"{root}/alerts", f"{root}/checkpoint", "alerts", 2)
    assert sum(T.caught_up(query)) == 90
    topic = T.Topic(f"{root}/alerts")
    before = topic.state()
    assert sum(before["next"].values()) == 90 and before["batches"] == {"alerts": 0}
    T.TopicStreamWriter({"path": f"{root}/alerts", "writer": "alerts", "partitions": "2"}, messages(spark, 0, 1).schema).commit([T._Written([(0, "x", 9)])], 0)
    assert topic.state() == before
    # The batch is repeated after its commit record is lost: nothing is appended twice.
    for record in (tmp_path / "checkpoint" / "commits").iterdir():
        if not record.name.endswith(".crc") or record.name.startswith("."):
            os.replace(record, tmp_path / f"lost-{record.name}")
    assert sum(T.caught_up(T.sink_topic(out.select("key", "value"), f"{root}/alerts", f"{root}/checkpoint", "alerts", 2))) in (0, 90)
    assert topic.state() == before


def test_uncommitted_segments_do_not_count(spark, tmp_path):
    topic = T.Topic(str(tmp_path / "topic"))
    assert topic.state()["next"] == {} and topic.segments({}, {}) == []
    writer = T.TopicWriter({"path": str(tmp_path / "topic"), "partitions": "2"}, messages(spark, 0, 1).schema)
    message = writer.write(iter([("1", "k1"), (None, None)]))
    assert topic.state()["next"] == {} and len(list((tmp_path / "topic" / "segments").iterdir())) >= 1
    writer.abort([message, None])
    assert not list((tmp_path / "topic" / "segments").iterdir())
    with pytest.raises(ValueError):
        T.TopicReader({"path": "x", "maxoffsetspertrigger": "5"})
    with pytest.raises(ValueError):
        T.TopicWriter({"path": "x"}, spark.range(1).schema)
    assert json.dumps(topic.state()) == '{"next": {}, "batches": {}}'
