"""Transaction table: read, index, project, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import feature_array
from tallyrisk.operators.order import global_index

# The reference layout of the transaction table.
CARD_FEATURES = [f"V{i}" for i in range(1, 29)] + ["Amount"]
TIME, TARGET = "seq", "Class"


def scan_transactions(spark: SparkSession, path: str, label: str = TARGET, seq: str = TIME,
                      order: Sequence[str] = ()) -> DataFrame:
    """Read Parquet, cast the label to int and add `seq` when absent.

    The order lives in `seq`; rows are not sorted physically. Without `order` rows count by file name and by their
    place in the file, however Spark deals the files to tasks.
    """
    df = spark.read.parquet(path)
    placed = df.withColumns({label: F.col(label).cast("int"), "_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    if seq in df.columns:
        return placed.select(*df.columns)
    return global_index(placed, [*order, "_file", "_row"], seq, keep=df.columns)


def project_features(df: DataFrame, features: Sequence[str] = CARD_FEATURES) -> DataFrame:
    return df.select(*features)


def filter_legit(df: DataFrame, label: str = "label") -> DataFrame:
    """Training rows without a positive label, for detectors that must not see positives."""
    return df.filter((F.col("split") == "train") & (F.col(label) == 0))


def export_instances(df: DataFrame, features: Sequence[str], path: str) -> None:
    """One JSON array of features per line."""
    df.select(F.to_json(feature_array(features)).alias("value")).write.text(path)


def write_split_parts(df: DataFrame, path: str) -> None:
    """The split table as one Parquet directory per slice."""
    df.write.partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A stage report as JSON lines; reports are small, so one file, behind an exchange so that the work stays spread."""
    report.repartition(1).write.mode("overwrite").json(path)
