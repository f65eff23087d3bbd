"""Reports over the landed outputs of a scoring run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import millis_between
from tallyrisk.operators.quantiles import column_quantiles

LATENCY_PROBS = (0.5, 0.95, 0.99)


def latency_percentiles(scored: DataFrame, later: Sequence[str] = ("scored_at",), earlier: str = "produced_at") -> DataFrame:
    """One row per later stamp: p50, p95, p99 and max of its distance in ms, one decimal."""
    spans = scored.select(*[millis_between(F.col(c), F.col(earlier)).cast("double").alias(c) for c in later])
    found = column_quantiles(spans, list(later), [*LATENCY_PROBS, 1.0])
    rows = [(c, *[round(v, 1) for v in found[c]]) for c in later if found[c]]
    return scored.sparkSession.createDataFrame(
        rows, "stamp string, p50_ms double, p95_ms double, p99_ms double, max_ms double")


def latency_budget(percentiles: DataFrame, budget_ms: float = 10.0) -> DataFrame:
    return percentiles.withColumn("meets_budget", F.col("p95_ms") <= F.lit(budget_ms))


def throughput(scored: DataFrame, start: str = "produced_at", end: str = "scored_at") -> DataFrame:
    """events, wall seconds from first start to last end, events per second (1 dp)."""
    span = millis_between(F.max(end), F.min(start)) / 1000.0
    return scored.agg(F.count(F.lit(1)).alias("events"), span.alias("seconds")).withColumn(
        "events_per_second", F.when(F.col("seconds") > 0, F.round(F.col("events") / F.col("seconds"), 1)))


def progress_throughput(query) -> float:
    """Rows per second over the batches a streaming query still remembers."""
    batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
    millis = sum(p["durationMs"].get("triggerExecution", 0) for p in batches)
    return 1000.0 * sum(p["numInputRows"] for p in batches) / millis if millis else 0.0


def stream_alert_report(scored: DataFrame, alert: str = "is_alert", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    flagged, positive = F.col(alert), F.col(label) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(flagged).alias("alerts"), F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"), F.count_if(~flagged & positive).alias("fn"))
    return counts.withColumn(
        "precision", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), 4)).withColumn(
        "recall", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 4))


def visible_lag(scored: DataFrame, stamp: str = "scored_at", produced: str = "produced_at",
                written: str | None = None) -> DataFrame:
    """Per micro-batch stamp: rows visible so far and how far the newest event lies behind.

    The stamp is constant in a micro-batch. Running figures are taken inside each hour, on top of what the hours before
    hold, so that no task sees more than an hour's batches or one row per hour.
    """
    seen = F.max(F.col(written)) if written else F.max(stamp)
    batches = scored.groupBy(F.col(stamp).alias("sampled_at")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(produced).alias("_newest"), seen.alias("_seen"))
    batches = batches.withColumn("_hour", F.date_trunc("hour", "sampled_at"))
    earlier = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = batches.groupBy("_hour").agg(F.sum("_rows").alias("_rows"), F.max("_newest").alias("_newest")).select(
        "_hour", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.max("_newest").over(earlier).alias("_newest_before"))
    so_far = Window.partitionBy("_hour").orderBy("sampled_at").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.greatest(F.max("_newest").over(so_far), F.col("_newest_before"))
    return batches.join(hours, "_hour").select(
        "sampled_at", (F.sum("_rows").over(so_far) + F.col("_before")).alias("scored"),
        F.round(millis_between(F.col("_seen"), newest) / 1000.0, 1).alias("visible_lag_s"))


def seed_stability(runs: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of a metric over runs, 4 dp."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg(metric), 4).alias("mean"),
                                 F.round(F.stddev_pop(metric), 4).alias("std"))


def cost_estimate(usage: DataFrame, quantity: str = "quantity", price: str = "unit_price", by: Sequence[str] = ()) -> DataFrame:
    """Sum of quantity times unit price, 4 dp."""
    return usage.groupBy(*by).agg(F.round(F.sum(F.col(quantity) * F.col(price)), 4).alias("total"))


def model_select(runs: DataFrame, metric: str = "val_pr_auc", order: str = "run_idx", by: Sequence[str] = ()) -> DataFrame:
    """The run with the highest metric; the earliest run wins a tie."""
    best = F.max_by(F.struct(*[c for c in runs.columns if c not in by]), F.struct(F.col(metric), -F.col(order)))
    return runs.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")
