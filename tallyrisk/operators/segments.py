"""Reports over cluster assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_report(assigned: DataFrame, k: int, cluster: str = "cluster", label: str = "label",
                   by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, rate (5 dp) and lift over the base rate (1 dp) of every cluster 0..k-1.

    Empty clusters stay with rate 0; lift is NULL when there is no positive at all.
    """
    held = assigned.groupBy(*by, F.col(cluster).cast("int").alias("cluster")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"))
    every = held.select(*by).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if by \
        else assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    filled = every.join(held, [*by, "cluster"], "left").fillna(0, ["rows", "frauds"])
    whole = Window.partitionBy(*by)  # k rows per group
    base = F.sum("frauds").over(whole) / F.sum("rows").over(whole)
    rate = F.when(F.col("rows") > 0, F.col("frauds") / F.col("rows")).otherwise(0.0)
    return filled.select(
        *by, "cluster", "rows", "frauds", F.round(rate, 5).alias("fraud_rate"),
        F.when(base > 0, F.round(rate / base, 1)).alias("lift_vs_base"))
