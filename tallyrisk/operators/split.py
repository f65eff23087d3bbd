"""Leak-free time split, prefixes, halves and seeded samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.operators.order import global_index

CELLS = 4096  # counts that a narrowing pass of `value_at` brings to the driver


def split_points(n: int, train_frac: float = 0.7, val_frac: float = 0.1) -> tuple[int, int]:
    """Row positions of the two cuts; the float products are truncated, so 0.8 of 1000 is 799."""
    return int(n * train_frac), int(n * (train_frac + val_frac))


def value_at(df: DataFrame, rank: int, column: str) -> tuple[int, int] | None:
    """(value, rows below it) of the integer column's value at a 0-based rank; None where there are fewer rows.

    The range that holds the rank is narrowed by counts of even cells to the values of one, at most six passes over one
    column: nothing is sorted and no row moves.
    """
    x = F.col(column).cast("long")
    row = df.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("rows")).first()
    low, high, below = row["low"], row["high"], 0
    if rank >= row["rows"]:
        return None
    while high > low:
        width = (high - low) // CELLS + 1
        cell = F.expr(f"(cast(`{column}` as bigint) - ({low})) div {width}")
        counts = df.filter(x.between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count(x).alias("count"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("cell").collect()  # at most CELLS + 1
        for r in counts:
            if below + r["count"] > rank:
                low, high = r["low"], r["high"]
                break
            below += r["count"]
    return low, below


def _parts(df: DataFrame, ranks: Sequence[int], seq: str, dense: bool, ties: Sequence[str] = ()) -> DataFrame:
    """Add `_part`: how many of the ascending ranks a row's position in `seq` order has reached.

    With `dense` the column is the position. Otherwise the values at the ranks decide, and only rows tied at a cut are
    numbered, in the order of `ties`. Columns that are not whole numbers are numbered as a whole.
    """
    if dense:
        return df.withColumn("_part", sum((F.col(seq) >= r).cast("int") for r in ranks))
    if df.schema[seq].dataType.typeName() not in ("byte", "short", "integer", "long"):
        placed = global_index(df, [seq, *ties], "_position")
        return placed.withColumn("_part", sum((F.col("_position") >= r).cast("int") for r in ranks)).drop("_position")
    part, tied, numbered = F.lit(0), F.lit(False), []
    cuts = [value_at(df, r, seq) if r > 0 else (None, 0) for r in ranks]
    for rank, cut in zip(ranks, cuts):
        if cut is None:
            continue
        value, below = cut
        part = part + (F.lit(1) if value is None else (F.col(seq) >= value).cast("int"))
        if value is not None and below < rank:
            tied = tied | (F.col(seq) == value)
            numbered.append((value, below))
    out = df.filter(~tied).withColumn("_part", part) if numbered else df.withColumn("_part", part)
    for value, below in dict(numbered).items():
        tie = global_index(df.filter(F.col(seq) == value), [seq, *ties], "_place")
        reached = sum((F.col("_place") + below >= r).cast("int") for r in ranks)
        out = out.unionByName(tie.withColumn("_part", reached).drop("_place"))
    return out


def time_split(df: DataFrame, train_frac: float = 0.7, val_frac: float = 0.1, seq: str = "seq",
               dense: bool = False, rows: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Add `split` in (train, val, test) by position in the order of `seq`, then `ties`; see `_parts` for `dense`."""
    n = df.count() if rows is None else rows
    placed = _parts(df, split_points(n, train_frac, val_frac), seq, dense, ties)
    part = F.when(F.col("_part") == 0, "train").when(F.col("_part") == 1, "val").otherwise("test")
    return placed.withColumn("split", part).select(*df.columns, "split")


def split_summary(df: DataFrame, label: str = "label", seq: str = "seq") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"), F.round(F.avg(label), 6).alias("fraud_rate"),
        F.min(seq).alias("seq_from"), F.max(seq).alias("seq_to"))


def time_prefix_sample(df: DataFrame, frac: float, seq: str = "seq", dense: bool = False,
                       rows: int | None = None) -> DataFrame:
    """The first int(n * frac) rows in time order."""
    n = int((df.count() if rows is None else rows) * frac)
    return _parts(df, [n], seq, dense).filter("_part = 0").select(*df.columns)


def split_halves(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Add `half` (first, second) by rank in `seq` order; the odd row goes second."""
    halves = _parts(df, [df.count() // 2], seq, False)
    return halves.withColumn("half", F.when(F.col("_part") == 0, "first").otherwise("second")).drop("_part")


def head_n(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n rows in `seq` order."""
    return _parts(df, [n], seq, False).filter("_part = 0").drop("_part")


def random_sample_fixed(df: DataFrame, size: int, key: str = "seq", seed: int = 0) -> DataFrame:
    """Exactly min(size, n) rows, chosen by a seeded hash of the key, whatever the partitioning.

    Only rows whose hash is in the lowest part that almost surely holds enough are ordered; should they be too few, all are.
    """
    order, n = F.xxhash64(F.col(key), F.lit(seed)), df.count()
    share = min(1.0, (size + 8.0 * math.sqrt(size) + 8.0) / max(n, 1))
    low = df.filter(order < int((2 * share - 1) * (1 << 63))) if share < 1 else df
    if share < 1 and low.count() < size:
        low = df
    return low.orderBy(order, F.col(key)).limit(size)


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def sort_report(df: DataFrame, by: str, tie: Sequence[str] = ()) -> DataFrame:
    """A report in descending order of one measure."""
    return df.orderBy(F.col(by).desc(), *tie)
