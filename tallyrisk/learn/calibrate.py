"""Isotonic calibration, fitted on validation and read on test."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.operators.curve import pr_auc, score_curve
from tallyrisk.operators.report import beside, brier, reliability_bins

INVERSE_GRID = 100_001  # fixed value: raw scores tried when a threshold is mapped back


def isotonic_fit(df: DataFrame, score: str = "score", label: str = "label") -> IsotonicRegressionModel:
    """Fit on distinct scores weighted by their rows, so tied scores cost one row each."""
    tied = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("_score")).agg(
        F.avg(F.col(label).cast("double")).alias("_rate"), F.count(F.lit(1)).cast("double").alias("_rows"))
    return IsotonicRegression(isotonic=True, featuresCol="_score", labelCol="_rate", weightCol="_rows",
                              predictionCol="calibrated").fit(tied)


def calibrate(model: IsotonicRegressionModel, df: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    """Add the calibrated score; scores outside the fitted range take the end values."""
    return model.transform(df.withColumn("_score", F.col(score))).withColumnRenamed("calibrated", name).drop("_score")


def calibration_report(calibrated: DataFrame, raw: str = "score", after: str = "calibrated", label: str = "label") -> DataFrame:
    """brier_raw, brier_calibrated, pr_auc_after of a slice that carries both scores."""
    return beside(brier(calibrated, raw, label).select(F.round("brier", 6).alias("brier_raw")),
                  brier(calibrated, after, label).select(F.round("brier", 6).alias("brier_calibrated")),
                  pr_auc(score_curve(calibrated, after, label)).select(F.round("pr_auc", 4).alias("pr_auc_after")))


def calibration_bins(calibrated: DataFrame, raw: str = "score", after: str = "calibrated", label: str = "label") -> DataFrame:
    return (reliability_bins(calibrated, raw, label).withColumn("kind", F.lit("raw"))
            .unionByName(reliability_bins(calibrated, after, label).withColumn("kind", F.lit("calibrated"))))


def calibrator_inverse(spark: SparkSession, model: IsotonicRegressionModel, threshold: float, points: int = INVERSE_GRID) -> DataFrame:
    """One row: the smallest raw score on an even grid of [0, 1] whose calibrated value reaches the threshold."""
    grid = spark.range(points).select((F.col("id") / F.lit(float(points - 1))).alias("score"))
    reached = F.min(F.when(F.col("calibrated") >= F.lit(threshold), F.col("score")))
    return calibrate(model, grid).agg(F.coalesce(reached, F.lit(1.0)).alias("raw_threshold"))
