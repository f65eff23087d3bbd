"""Ordered work without a single-task window: global row index and running totals.

Both range-partition on the order keys, number or accumulate inside each range ("run"), land the
outcome once, and shift every run by what the earlier runs hold. Only one row per run and group
crosses the second aggregation, so nothing grows with the data except the range exchange itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.landing import land

# monotonically_increasing_id keeps the partition above bit 33 and the row position below it.
_POSITION_BITS = 33


def _sort_expr(key: str | Column) -> Column:
    return F.col(key) if isinstance(key, str) else key


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "seq",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Add a dense 0-based index in the given order; equal rows keep their arrival order.

    `keep` names the columns wanted afterwards, so that pure sort keys are not written.
    The arrival id is the last order key, so a value shared by a third of all rows is still spread
    over many ranges.
    """
    keys = [_sort_expr(key) for key in order] + [F.col("_arrival")]
    kept = df.columns if keep is None else list(keep)
    placed = (df.withColumn("_arrival", F.monotonically_increasing_id())
              .repartitionByRange(*keys)
              .sortWithinPartitions(*keys)
              .withColumn("_slot", F.monotonically_increasing_id())
              .select(*kept, "_slot"))
    landed = (land(placed, "index")
              .withColumn("_run", F.shiftright("_slot", _POSITION_BITS))
              .withColumn("_place", F.col("_slot").bitwiseAND((1 << _POSITION_BITS) - 1)))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = land(landed.groupBy("_run").agg((F.max("_place") + 1).alias("_rows"))
                  .select("_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "starts")
    # One row per range partition: its size is bounded by the partition count, not by the data.
    return (landed.join(F.broadcast(starts), "_run")
            .select(*kept, (F.col("_start") + F.col("_place")).alias(name)))


def index_within(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Like `global_index`, counted from 0 inside each combination of the (non-null) `by` columns."""
    indexed = global_index(df, [*by, *order], name)
    if not by:
        return indexed
    starts = indexed.groupBy(*by).agg(F.min(name).alias("_from"))
    return (indexed.join(starts, list(by)).withColumn(name, F.col(name) - F.col("_from"))
            .select(*df.columns, name))


def _accumulate(group: str, sums: Sequence[str], ahead: Sequence[str]):
    """Arrow batches of one sorted run in, the same rows with in-run totals out.

    The last row of a batch is held back until its successor is known, because `next_*` needs it.
    """

    def segment_bases(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        lengths = np.diff(np.concatenate([[0], starts, [len(keys)]]))
        return np.repeat(np.concatenate([[0], total[starts - 1]]), lengths), starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = TaskContext.get().partitionId()
        carry: dict[str, int] = dict.fromkeys(sums, 0)
        added = ["_run", "_place", *[f"_in_{s}" for s in sums], *[f"_next_{c}" for c in ahead]]
        place, last_group, pending = 0, None, None

        def emit(held: dict, first: dict | None) -> pa.RecordBatch:
            follows = first is not None and first["group"] == held["last_group"]
            columns = list(held["columns"])
            for name in ahead:
                values = held["values"][name]
                tail = first["values"][name] if follows else values[:1]
                mask = np.append(held["breaks"], not follows)
                columns.append(pa.array(np.concatenate([values[1:], tail]), mask=mask))
            return pa.RecordBatch.from_arrays(columns, names=held["names"])

        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            labels = batch.column(batch.schema.get_field_index(group))
            codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            values = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                      for name in {*sums, *ahead}}
            first_group, end_group = labels[0].as_py(), labels[rows - 1].as_py()
            if pending is not None:
                yield emit(pending, {"group": first_group, "values": {c: values[c][:1] for c in ahead}})
            ordinal = np.arange(1, rows + 1, dtype=np.int64)
            bases, starts = segment_bases(codes, ordinal)
            continued = first_group == last_group
            head = int(starts[0]) if len(starts) else rows
            ordinal = ordinal - bases
            if continued:
                ordinal[:head] += place
            totals = []
            for name in sums:
                total = np.cumsum(values[name])
                bases, _ = segment_bases(codes, total)
                total = total - bases
                if continued:
                    total[:head] += carry[name]
                carry[name] = int(total[-1])
                totals.append(pa.array(total, type=pa.int64()))
            place, last_group = int(ordinal[-1]), end_group
            breaks = codes[1:] != codes[:-1]
            pending = {"last_group": end_group, "values": values, "breaks": breaks,
                       "names": [*batch.schema.names, *added],
                       "columns": [*batch.columns, pa.array(np.full(rows, run_id, dtype=np.int64)),
                                   pa.array(ordinal - 1), *totals]}
        if pending is not None:
            yield emit(pending, None)

    return run


def running_totals(df: DataFrame, group: str, order: Sequence[Column], sums: Sequence[str],
                   ahead: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of `sums` inside each `group` value, in `order`.

    `group` is a non-null string column, `sums` are non-null longs, `ahead` non-null numbers. Adds
    `run_<s>` (running sum), `all_<s>` (group total), `next_<a>` (value on the following row of the
    group, NULL on its last row), `place` (dense position in the group) and `places` (its rows).
    """
    keys = [F.col(group), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = ([T.StructField("_run", T.LongType()), T.StructField("_place", T.LongType())]
             + [T.StructField(f"_in_{s}", T.LongType()) for s in sums]
             + [T.StructField(f"_next_{c}", df.schema[c].dataType) for c in ahead])
    schema = T.StructType([*placed.schema.fields, *added])
    landed = land(placed.mapInArrow(_accumulate(group, sums, ahead), schema), "totals")

    in_group = Window.partitionBy(group)
    earlier = in_group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = landed.groupBy(group, "_run").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
        *[F.max(F.when(F.col("_place") == 0, F.col(c))).alias(f"_first_{c}") for c in ahead])
    shifts = runs.select(
        F.col(group), "_run",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_rows").over(in_group).alias("places"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(in_group).alias(f"all_{s}") for s in sums],
        *[F.lead(f"_first_{c}").over(in_group.orderBy("_run")).alias(f"_after_{c}") for c in ahead])
    # One row per run and group, written too, so that every reader of the totals joins a tiny table;
    # Spark broadcasts it only under its own size limit.
    shifts = land(shifts, "shifts")
    return landed.join(shifts, [group, "_run"]).select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_base_{s}")).alias(f"run_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
        *[F.coalesce(f"_next_{c}", f"_after_{c}").alias(f"next_{c}") for c in ahead],
        (F.col("_start") + F.col("_place")).alias("place"), "places")
