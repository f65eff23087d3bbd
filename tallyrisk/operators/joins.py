"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land

ROWS_PER_TASK = 4_000_000  # rows of one key that a task may meet before the key is split


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, _salts) of keys with more rows than a task should meet, and in how many parts to cut each.

    At most rows / rows_per_task keys. Written once, because both sides of a join need it.
    """
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
    return land(counted.select(*on, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_salts")), "hot-keys")


def balanced_join(many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "inner",
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join whose left side may have hot keys; the right side holds each key a bounded number of times.

    Rows of a hot key are spread over as many parts as the key has tasks' worth of rows, and the matching right rows
    repeated that often; every other row keeps part 0.
    """
    on = list(on)
    hot = hot_keys(many, on, rows_per_task)
    # The task number joins the hash so that full copies of a row spread too; unlike a row counter it
    # is the same when a lost task is run again.
    spread = F.xxhash64(*many.columns, F.spark_partition_id())
    left = many.withColumn("_spread", spread).join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.col("_spread"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts", "_spread")
    right = one.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def join_scores_by_id(streamed: DataFrame, truth: DataFrame, key: str = "event_id") -> DataFrame:
    """Each streamed row beside the batch row of the same id; repeated ids on the stream are kept."""
    return balanced_join(streamed, truth, [key])


def missing_after_stream(expected: DataFrame, scored: DataFrame, key: str = "event_id") -> DataFrame:
    """Expected rows that no scored row carries; scored ids are made distinct before the join."""
    return expected.join(scored.select(key).distinct(), key, "left_anti")


def duplicate_count(df: DataFrame, key: str = "event_id") -> DataFrame:
    """rows, distinct ids and their difference; ids are first counted per key, so a hot id is one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def score_agreement(remote: DataFrame, local: DataFrame, threshold: float, key: str = "event_id") -> DataFrame:
    """rows compared, largest absolute score difference, and whether all alert flags agree.

    Both sides are reduced to one row per id first, so the join is one to one for any skew. `remote`
    holds score and is_alert; `local` holds score.
    """
    theirs = remote.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.bool_and("is_alert").alias("all_alert"), F.bool_or("is_alert").alias("any_alert"))
    ours = local.groupBy(key).agg(F.max("score").alias("score"))
    alert = F.col("score") >= F.lit(threshold)
    return theirs.join(ours, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.max(F.greatest(F.abs(F.col("low") - F.col("score")), F.abs(F.col("high") - F.col("score"))))
        .alias("max_abs_score_diff"),
        F.coalesce(F.bool_and((F.col("all_alert") == alert) & (F.col("any_alert") == alert)), F.lit(True))
        .alias("alerts_identical"))


def join_ref_bins(values: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """(feature, value) rows with the bin of their feature's edge list.

    `edges` has one row per feature with an array<double> of at most bins + 1 unique edges, so it is
    bounded by the column count and broadcast.
    """
    inner = F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    index = sum((F.when(F.coalesce(F.get(F.col("_inner"), F.lit(i)) <= F.col("value"), F.lit(False)), 1).otherwise(0)
                 for i in range(bins - 1)), F.lit(0))
    return values.join(F.broadcast(edges.withColumn("_inner", inner)), "feature").withColumn("bin", index) \
        .drop("edges", "_inner")
