"""The driver's tables as a transaction table and an event stream.

Fixed values: the feature columns, the label rule, the rule scores and their thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.functions.scalars import sigmoid
from tallyrisk.landing import SMALL_GROUPS, land
from tallyrisk.operators.order import global_index
from tallyrisk.operators.split import time_split
from tallyrisk.session import prepare

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
AMOUNT = "l_extendedprice"
# No shorter column list is a key, so the time order is settled by every column.
TIME_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
THRESHOLD = 0.6
EVENT_THRESHOLD = 0.64

_PREPARED: dict[tuple, DataFrame] = {}


def label_rule() -> Column:
    return ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 45)).cast("int")


def _nine_places(value: Column) -> Column:
    """Cut to nine decimals in plain double arithmetic, so that engines agree on ties."""
    return F.floor(value * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def score_a() -> Column:
    """Rule score with heavy ties."""
    return _nine_places(sigmoid(F.lit(0.1) * F.col("l_quantity") + F.lit(40.0) * F.col("l_discount") - F.lit(8.0)))


def score_b() -> Column:
    """Rule score whose values are mostly distinct."""
    return _nine_places(sigmoid(F.lit(0.1) * F.col("l_quantity") + F.lit(40.0) * F.col("l_discount") - F.lit(8.0)
                                + F.col("l_extendedprice") * F.lit(0.00001)))


def raw_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/lineitem.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, features, label, split: indexed and split once per session, then read back by split."""
    key = (spark.sparkContext.applicationId, "transactions", sf_dir)
    if key not in _PREPARED:
        raw = raw_lineitem(spark, sf_dir).withColumn("label", label_rule())
        indexed = global_index(raw, TIME_ORDER, keep=[*FEATURES, "label"])
        _PREPARED[key] = land(time_split(indexed, dense=True), "transactions", ["split"], SMALL_GROUPS)
    return _PREPARED[key]


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`transactions` without seq: unless the session has that table, only rows of the moments of the two cuts are ordered."""
    context = spark.sparkContext.applicationId
    if (context, "transactions", sf_dir) in _PREPARED:
        return transactions(spark, sf_dir).drop("seq")
    key = (context, "split_rows", sf_dir)
    if key not in _PREPARED:
        # Sessions are in UTC, so a time without a zone reads as the same moment; Spark would convert each row's, several times over.
        zoned = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
                 for f in raw_lineitem(spark, sf_dir).schema]
        raw = spark.read.schema(T.StructType(zoned)).parquet(f"{sf_dir}/lineitem.parquet").withColumn("label", label_rule())
        # Spark's order begins with the rows without a moment.
        raw = raw.withColumn("_moment", F.coalesce(F.unix_micros(F.col(TIME_ORDER[0]).cast("timestamp")), F.lit(-(1 << 62))))
        _PREPARED[key] = time_split(raw, seq="_moment", ties=TIME_ORDER).select(*FEATURES, "label", "split")
    return _PREPARED[key]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(transactions(spark, sf_dir))


def with_scores(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score_a", score_a()).withColumn("score_b", score_b())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (UTC timestamp), value, label, and a score in [0, 1) that grows with the value."""
    raw = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value",
                      (F.col("value") >= 200).cast("int").alias("label"), event_score(F.col("value")).alias("score"))


def event_score(value: Column) -> Column:
    return value / (value + F.lit(100.0))
