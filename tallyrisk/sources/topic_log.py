"""A partitioned log of messages in files, read and written through Spark's Python Data Source interface.

What a message broker's topic offers to a query, kept in a shared folder: numbered partitions, an offset for every message, readers
that begin at the earliest or latest offsets or where their checkpoint stands, at most so many messages a trigger, and the same
messages again when a batch is repeated.

Layout under the topic's path: `segments/` holds Parquet files of (key, value), one for each task and partition; `commits/` holds one
JSON file for each append, which gives its segments their first offsets and carries the next free offset of every partition. A
segment counts only once its commit is there, under a name that appears whole, so a failed or repeated task leaves no message
behind. Appends are numbered; one writer at a time may append to a topic. A stream's repeated batch is appended once.

Paths are those pyarrow's file systems know (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMAT = "topic_log"
MESSAGE_SCHEMA = "partition int, offset long, key string, value string"
PARTITIONS, FLUSH_ROWS = 8, 10_000
_SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string())])


class Topic:
    """The files of one topic."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of all appends, in order."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def commit_of(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/commits/{version:020d}.json") as held:
            return json.loads(held.read())

    def state(self) -> dict:
        """The last append: next offsets of the partitions, and the last batch of every stream that writes."""
        versions = self.versions()
        return self.commit_of(versions[-1]) if versions else {"next": {}, "batches": {}}

    def append(self, segments: list[tuple[int, str, int]], partitions: int, writer: str | None = None, batch: int | None = None) -> None:
        """Give the segments (partition, file, rows) their offsets; nothing where the stream's batch is there already."""
        versions = self.versions()
        last = self.commit_of(versions[-1]) if versions else {"next": {}, "batches": {}}
        if writer is not None and last["batches"].get(writer, -1) >= batch:
            return
        ends, placed = {**{str(p): 0 for p in range(partitions)}, **last["next"]}, []
        for partition, file, rows in sorted(segments):
            placed.append([partition, ends[str(partition)], rows, file])
            ends[str(partition)] += rows
        batches = last["batches"] if writer is None else {**last["batches"], writer: batch}
        version = versions[-1] + 1 if versions else 0
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        hidden = f"{self.root}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as out:
            out.write(json.dumps({"next": ends, "batches": batches, "segments": placed}).encode())
        self.fs.move(hidden, f"{self.root}/commits/{version:020d}.json")

    def segments(self, start: dict, end: dict) -> list[tuple[int, str, int, int, int]]:
        """(partition, file, first offset, from, to) of every segment with messages of the range; newest appends first."""
        found, open_ = [], {p for p, e in end.items() if e > start.get(p, 0)}
        for version in reversed(self.versions()):
            if not open_:
                break
            for partition, first, rows, file in reversed(self.commit_of(version)["segments"]):
                p = str(partition)
                low, high = max(first, start.get(p, 0)), min(first + rows, end.get(p, 0))
                if low < high:
                    found.append((partition, file, first, low, high))
                if first <= start.get(p, 0):
                    open_.discard(p)
        return sorted(found)


class _Slice(InputPartition):
    def __init__(self, partition: int, file: str, first: int, low: int, high: int):
        self.partition, self.file, self.first, self.low, self.high = partition, file, first, low, high


class TopicReader(DataSourceStreamReader):
    """Options: `path`, `startingOffsets` (earliest or latest), `maxOffsetsPerTrigger`, and the query's `checkpoint` where that limit is set."""

    def __init__(self, options: dict):
        self.path, self.latest = options["path"], options.get("startingoffsets", "earliest") == "latest"
        self.most = int(options["maxoffsetspertrigger"]) if "maxoffsetspertrigger" in options else None
        self.checkpoint, self.planned = options.get("checkpoint"), None
        if self.most is not None and (self.most < 1 or self.checkpoint is None):
            raise ValueError("maxOffsetsPerTrigger takes a number of 1 or more and the query's checkpoint")

    def initialOffset(self) -> dict:
        ends = Topic(self.path).state()["next"]
        return dict(ends) if self.latest else {p: 0 for p in ends}

    def latestOffset(self) -> dict:
        """The log's end, or as far as the limit lets the next batch go, evenly over what the partitions still hold."""
        ends = Topic(self.path).state()["next"]
        if self.most is None:
            return ends
        start = self.planned or self._checked() or self.initialOffset()
        left = {p: max(0, e - start.get(p, 0)) for p, e in ends.items()}
        total, out, spare = sum(left.values()), {p: start.get(p, 0) for p in ends}, self.most
        if total <= self.most:
            return {p: max(e, start.get(p, 0)) for p, e in ends.items()}
        for p in left:
            take = left[p] * self.most // total
            out[p], left[p], spare = out[p] + take, left[p] - take, spare - take
        for p in left:
            take = min(left[p], spare)
            out[p], spare = out[p] + take, spare - take
        return out

    def _checked(self) -> dict | None:
        """Where the checkpoint's last planned batch ends: the next one begins there."""
        held = Topic(self.checkpoint)
        found = held.fs.get_file_info(pafs.FileSelector(f"{held.root}/offsets", allow_not_found=True))
        numbers = sorted(int(f.base_name) for f in found if f.base_name.isdigit())
        if not numbers:
            return None
        with held.fs.open_input_stream(f"{held.root}/offsets/{numbers[-1]}") as log:
            return json.loads(log.read().decode().strip().split("\n")[-1])

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        self.planned = end
        return [_Slice(*s) for s in Topic(self.path).segments(start, end)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        topic = Topic(self.path)
        with topic.fs.open_input_file(f"{topic.root}/segments/{part.file}") as held:
            file = pq.ParquetFile(held)
            groups, at = _groups_of(file, part)
            for batch in file.iter_batches(FLUSH_ROWS, groups):
                low, high = max(part.low - at, 0), min(part.high - at, batch.num_rows)
                if low < high:
                    mine = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.partition] * mine.num_rows, pa.int32()), pa.array(range(at + low, at + high), pa.int64()), *mine.columns],
                        names=["partition", "offset", "key", "value"])
                at += batch.num_rows


def _groups_of(file: pq.ParquetFile, part: _Slice) -> tuple[list[int], int]:
    """The row groups that hold messages of the slice, and the offset at which the first of them begins."""
    found, begins, at = [], part.low, part.first
    for g in range(file.num_row_groups):
        rows = file.metadata.row_group(g).num_rows
        if at < part.high and at + rows > part.low:
            begins = begins if found else at
            found.append(g)
        at += rows
    return found, begins


class _Written(WriterCommitMessage):
    def __init__(self, segments: list[tuple[int, str, int]]):
        self.segments = segments


class _Segments:
    """What tasks do to append: a segment for each partition, rows to the partition of their key's hash, those without a key in turns."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.count = options["path"], int(options.get("partitions", PARTITIONS))
        self.names = [f.name for f in schema.fields]
        self.writer = options.get("writer")
        if "value" not in self.names:
            raise ValueError("messages need a column value")

    def write(self, rows: Iterator) -> _Written:
        topic, task = Topic(self.path), uuid.uuid4().hex
        held: dict[int, list] = {}
        open_: dict[int, pq.ParquetWriter] = {}
        done: dict[int, int] = {}
        topic.fs.create_dir(f"{topic.root}/segments", recursive=True)
        key_at, value_at = self.names.index("key") if "key" in self.names else None, self.names.index("value")

        def flush(p: int) -> None:
            if p not in open_:
                open_[p] = pq.ParquetWriter(f"{topic.root}/segments/{task}-{p}.parquet", _SEGMENT, filesystem=topic.fs)
            keys, values = zip(*held.pop(p))
            open_[p].write_table(pa.table([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=_SEGMENT))
            done[p] = done.get(p, 0) + len(keys)

        for n, row in enumerate(rows):
            key, value = None if key_at is None else row[key_at], row[value_at]
            p = (n if key is None else crc32(str(key).encode())) % self.count
            held.setdefault(p, []).append((None if key is None else str(key), value))
            if len(held[p]) >= FLUSH_ROWS:
                flush(p)
        for p in list(held):
            flush(p)
        for p in open_.values():
            p.close()
        return _Written([(p, f"{task}-{p}.parquet", n) for p, n in done.items()])

    def _drop(self, messages: list) -> None:
        topic = Topic(self.path)
        for message in messages:
            for _, file, _ in message.segments if message is not None else ():
                topic.fs.delete_file(f"{topic.root}/segments/{file}")


class TopicWriter(_Segments, DataSourceWriter):
    def commit(self, messages: list) -> None:
        Topic(self.path).append([s for m in messages if m is not None for s in m.segments], self.count)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class TopicStreamWriter(_Segments, DataSourceStreamWriter):
    """Option `writer` names the stream: its repeated batches are appended once."""

    def commit(self, messages: list, batchId: int) -> None:
        Topic(self.path).append([s for m in messages if m is not None for s in m.segments], self.count, self.writer or "stream", batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE_SCHEMA

    def streamReader(self, schema: StructType) -> TopicReader:
        return TopicReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return TopicWriter({k.lower(): v for k, v in self.options.items()}, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, by value, so that workers need not have the package."""
    import tallyrisk.sources.topic_log as here

    cloudpickle.register_pickle_by_value(here)
    spark.dataSource.register(TopicLog)
    return spark


def append_topic(df: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Append `value` (and `key`) of every row as messages, in one commit."""
    register(df.sparkSession)
    kept = [c for c in ("key", "value") if c in df.columns]
    df.select(*[df[c].cast("string").alias(c) for c in kept]).write.format(FORMAT).option("partitions", partitions).mode("append").save(path)


def scan_topic(spark: SparkSession, path: str, starting: str = "earliest", max_offsets: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Messages of a topic as a stream; `max_offsets` caps a trigger and needs the query's checkpoint folder."""
    reader = register(spark).readStream.format(FORMAT).option("path", path).option("startingOffsets", starting)
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets).option("checkpoint", checkpoint)
    return reader.load()


def sink_topic(df: DataFrame, path: str, checkpoint: str, writer: str, partitions: int = PARTITIONS, every: str | None = "0 seconds") -> StreamingQuery:
    """Append `key` and `value` of a stream to a topic, every batch once."""
    register(df.sparkSession)
    out = df.select("key", "value").writeStream.format(FORMAT).option("path", path).option("partitions", partitions).option("writer", writer)
    out = out.option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def caught_up(query: StreamingQuery) -> list[int]:
    """Wait until a stream has read its topic to the end, stop it, and return the rows of its batches."""
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
