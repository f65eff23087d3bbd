"""Scoring of events and instances: column expressions, MLlib models, or a broadcast model file."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.functions.scalars import map_value

# Most and fewest rows per model call, and the longest a row waits for others.
ARROW_BATCH = 2000
LEAST_ROWS = 64
WAIT_SECONDS = 0.5


def set_event_batching(spark: SparkSession, rows: int = ARROW_BATCH) -> None:
    """Upper size of one model call in Python scoring."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def open_linear(content: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer from JSON {weights, bias}: sigmoid of the weighted sum."""
    spec = json.loads(content)
    weights, bias = np.asarray(spec["weights"], dtype=np.float64), float(spec["bias"])
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ weights + bias)))


def open_onnx(content: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer from an ONNX file with one input table.

    The last output is the score. Its width is asked once, of a row of zeros: of two columns the last is the positive
    class's, so in either case it is the last column that counts.
    """
    from onnxruntime import InferenceSession, SessionOptions

    single = SessionOptions()
    single.intra_op_num_threads = 1  # Spark has a task per core already
    model = InferenceSession(content, single, providers=["CPUExecutionProvider"])
    source, wanted = model.get_inputs()[0], [model.get_outputs()[-1].name]
    probe = model.run(wanted, {source.name: np.zeros((1, source.shape[1]), np.float32)})[0]
    if probe.size > 2:
        raise ValueError(f"a score has one or two columns, not {probe.size}")
    return lambda x: model.run(wanted, {source.name: x.astype(np.float32)})[0].reshape(len(x), -1)[:, -1].astype(np.float64)


def score_udf(spark: SparkSession, content: bytes, opener: Callable[[bytes], Callable[[np.ndarray], np.ndarray]]):
    """array<double> -> double over a broadcast model file, opened once per worker process; Arrow batches in."""
    shared = spark.sparkContext.broadcast(content)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not hasattr(shared, "opened"):  # a reused worker finds the broadcast of an earlier task
            shared.opened = opener(shared.value)
        model = shared.opened
        for features in batches:
            yield pd.Series(model(np.stack(features.to_numpy()).astype(np.float64)) if len(features)
                            else np.empty(0))

    return score


def coalesced(batches: Iterator[pa.RecordBatch], least: int = LEAST_ROWS, most: int = ARROW_BATCH,
              wait_s: float = WAIT_SECONDS) -> Iterator[tuple[pa.RecordBatch, float, bool]]:
    """Batches put together, or cut, to `least` to `most` rows, each with the seconds its first row waited and whether input has ended.

    A call goes out as soon as it has `least` rows, with whatever else is there already; fewer go out when the first of them has
    waited `wait_s`, or at the end. A thread takes the input in, two batches ahead at most, so that waiting ends on time.
    """
    arrived: queue.Queue = queue.Queue(maxsize=2)

    def take_in() -> None:
        try:
            for batch in batches:
                arrived.put(batch)
            arrived.put(None)
        except BaseException as error:  # raised again where the batches are used
            arrived.put(error)

    threading.Thread(target=take_in, daemon=True).start()
    held: list[tuple[float, pa.RecordBatch]] = []  # with the time of arrival
    rows, ended = 0, False
    while True:
        left = None if not held else 0.0 if rows >= least else max(0.0, held[0][0] + wait_s - time.monotonic())
        while not ended and rows < most:
            try:
                item = arrived.get(timeout=left) if left is None or left > 0 else arrived.get_nowait()
            except queue.Empty:
                break
            if isinstance(item, BaseException):
                raise item
            ended = item is None
            if not ended and item.num_rows:
                held.append((time.monotonic(), item))
                rows += item.num_rows
            if held:
                left = 0.0 if rows >= least else max(0.0, held[0][0] + wait_s - time.monotonic())
        if not held:
            if ended:
                return
            continue
        call, size, since = [], 0, held[0][0]
        while held and size < most:
            at, batch = held.pop(0)
            if batch.num_rows > most - size:
                held.insert(0, (at, batch.slice(most - size)))
                batch = batch.slice(0, most - size)
            call.append(batch)
            size += batch.num_rows
        rows -= size
        yield pa.concat_batches(call), time.monotonic() - since, ended and not held


def score_batched(events: DataFrame, content: bytes, opener: Callable[[bytes], Callable[[np.ndarray], np.ndarray]],
                  features: str = "features", least: int = LEAST_ROWS, most: int = ARROW_BATCH, wait_s: float = WAIT_SECONDS) -> DataFrame:
    """Add `score` and the call that made it: `call_rows`, `call_waited_s`, and `call_last`, whether it ended its task's input.

    For sources whose rows trickle in: rows come to Python in batches of `spark.sql.execution.arrow.maxRecordsPerBatch` rows, so a small
    setting (`set_event_batching`) brings them early, and calls are put together here. `features` holds arrays of one length, none missing.
    """
    shared = events.sparkSession.sparkContext.broadcast(content)
    place = events.columns.index(features)
    added = [("score", pa.float64()), ("call_rows", pa.int32()), ("call_waited_s", pa.float64()), ("call_last", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opener(shared.value)
        for call, waited, last in coalesced(batches, least, most, wait_s):
            n = call.num_rows
            x = call.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            values = (model(x), np.full(n, n), np.full(n, waited), np.full(n, last))
            columns = [pa.array(v, kind) for v, (_, kind) in zip(values, added)]
            yield pa.RecordBatch.from_arrays([*call.columns, *columns], names=[*call.schema.names, *[name for name, _ in added]])

    schema = T.StructType([*events.schema, T.StructField("score", T.DoubleType()), T.StructField("call_rows", T.IntegerType()),
                           T.StructField("call_waited_s", T.DoubleType()), T.StructField("call_last", T.BooleanType())])
    return events.mapInArrow(run, schema)


def stream_score(events: DataFrame, score: Column, threshold: float) -> DataFrame:
    """event_id, score, is_alert, label, produced_at, scored_at; works on streams and tables alike.

    `scored_at` is constant in a micro-batch: it is the time the batch began.
    """
    return (events.withColumn("score", score)
            .withColumn("is_alert", F.col("score") >= F.lit(threshold))
            .select("event_id", "score", "is_alert", "label", F.col("event_time").alias("produced_at"),
                    F.current_timestamp().alias("scored_at")))


def instance_array(instances: Column, features: Sequence[str]) -> Column:
    """Named instances (map) as an ordered array; a missing feature counts 0.0."""
    return F.array(*[map_value(instances, name) for name in features])


def score_instances(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Add `prediction` = struct(score, fraud)."""
    return df.withColumn("prediction", F.struct(score.alias("score"), (score >= F.lit(threshold)).alias("fraud")))
