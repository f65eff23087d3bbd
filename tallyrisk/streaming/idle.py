"""Tumbling windows that close by themselves: a timer on each window's state instead of a later event.

A watermark closes a window only when a later event arrives, so the last windows of a stream that falls silent stay open. Here a
window closes once no row has reached it for a given time on the clock. Rows are added up inside the tasks before the exchange, so
a window that holds most of a batch costs one row a task.
"""

from __future__ import annotations

import time as clock
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyrisk.operators.drift import histogram_psi
from tallyrisk.streaming.windows import small_state

# The state store that keeps timers, and how long a closed window is remembered.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMEMBER_MS = 7 * 24 * 3600 * 1000

_SUMS = "events long, alerts long, scored long, score_sum double, bins array<long>"
_COUNTED = f"window_start timestamp, window_end timestamp, {_SUMS}"


def _bin(score: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges that are not above the score: the bin that `histogram_columns` counts it in."""
    return sum((score >= F.lit(edge)).cast("int") for edge in edges[1:-1]) + F.lit(0) * score.cast("int")


def _added_up(bins: int):
    """Rows (window_start, window_end, score, is_alert, bin) to one row of sums for each window of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for window, rows in batch.groupby(["window_start", "window_end"]):
                sums = held.setdefault(window, [0, 0, 0, 0.0, np.zeros(bins, dtype=np.int64)])
                sums[0] += len(rows)
                sums[1] += int(rows["is_alert"].sum())
                sums[2] += int(rows["score"].count())
                sums[3] += float(rows["score"].sum())
                sums[4] += np.bincount(rows["bin"].dropna().astype(int), minlength=bins)[:bins]
        rows = [(*window, *sums[:4], sums[4].tolist()) for window, sums in held.items()]
        yield pd.DataFrame(rows, columns=["window_start", "window_end", "events", "alerts", "scored", "score_sum", "bins"])

    return run


class IdleClose(StatefulProcessor):
    """Sums of one window; every row puts its timer off, and the timer emits the window and remembers that it is closed."""

    def __init__(self, idle_ms: int, remember_ms: int) -> None:
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", f"{_SUMS}, due long")
        self.closed = handle.getValueState("closed", "closed boolean", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        if self.closed.exists():
            for _ in rows:
                pass
            return iter(())
        before = self.sums.get()
        *sums, bins, due = before if before is not None else (0, 0, 0, 0.0, None, None)
        for row in rows:
            sums = [a + b for a, b in zip(sums, (row.events, row.alerts, row.scored, row.score_sum))]
            bins = list(row.bins) if bins is None else [a + b for a, b in zip(bins, row.bins)]
        if due is not None:
            self.handle.deleteTimer(due)
        # A batch's own time is its beginning, and a long batch is no silence.
        due = max(timerValues.getCurrentProcessingTimeInMs(), int(clock.time() * 1e3)) + self.idle_ms
        self.handle.registerTimer(due)
        self.sums.update((*sums, bins, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        *sums, _due = self.sums.get()
        self.sums.clear()
        self.closed.update((True,))
        yield Row(window_start=key[0], window_end=key[1], **dict(zip(("events", "alerts", "scored", "score_sum", "bins"), sums)))


def idle_windows(scored: DataFrame, width: str, edges: Sequence[float], reference: Sequence[float], idle_ms: int,
                 time: str = "produced_at", remember_ms: int = REMEMBER_MS) -> DataFrame:
    """The columns of `window_stats` for a stream, each window once, `idle_ms` after the last batch that held a row of it.

    Rows that come after their window closed change nothing, as long as it is remembered (`remember_ms`); one that comes later
    still opens it anew. Rows without a time belong to no window. A stream without rows gives none.
    """
    cut = F.window(time, width)
    rows = scored.filter(F.col(time).isNotNull()).select(cut.alias("w"), F.col("score").cast("double").alias("score"),
                                                         F.coalesce("is_alert", F.lit(False)).alias("is_alert"))
    rows = rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "score", "is_alert",
                       _bin(F.col("score"), edges).alias("bin"))
    counted = rows.mapInPandas(_added_up(len(edges) - 1), _COUNTED).groupBy("window_start", "window_end").transformWithState(
        IdleClose(idle_ms, remember_ms), _COUNTED, "append", "processingTime")
    named = counted.select("*", *[F.col("bins")[i].alias(f"bin_{i}") for i in range(len(edges) - 1)])
    mean = F.when(F.col("scored") > 0, F.col("score_sum") / F.col("scored"))
    return named.select("window_start", "window_end", "events", "alerts", F.round(mean, 6).alias("mean_score"),
                        F.round(histogram_psi(F.col("events"), reference), 6).alias("score_psi"))


@contextmanager
def timer_state(spark: SparkSession):
    """Start a query with timers: few state partitions, and the store that keeps timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, TIMER_STORE)
    try:
        with small_state(spark):
            yield
    finally:
        spark.conf.set(name, before)


def _started(progress) -> float:
    return datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()


def stop_when_idle(query: StreamingQuery, idle_ms: int = 0, timeout_s: float = 600.0) -> bool:
    """Stop a long-running query after a batch without input that began `idle_ms` after the last input was taken in.

    By then every timer of `idle_ms` has fired. With 0 the query stops as soon as it has caught up. False: stopped by the timeout.
    """
    last_input, deadline = clock.time(), clock.monotonic() + timeout_s
    try:
        while clock.monotonic() < deadline:
            failure = query.exception()
            if failure is not None:
                raise failure
            seen = query.recentProgress
            for progress in seen:
                if progress["numInputRows"] > 0:
                    last_input = max(last_input, _started(progress) + progress["durationMs"].get("triggerExecution", 0) / 1e3)
            if seen and seen[-1]["numInputRows"] == 0 and _started(seen[-1]) >= last_input + idle_ms / 1e3:
                return True
            clock.sleep(0.2)
        return False
    finally:
        query.stop()
