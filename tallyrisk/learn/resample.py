"""Class weights and synthetic minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.operators.neighbours import CELL_ROWS, knn_self_join
from tallyrisk.operators.order import global_index

STRATEGIES = ("none", "weights", "smote")


def class_counts(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """(positives, negatives)."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return row["p"], row["n"]


def positive_weight(df: DataFrame, label: str = "label") -> float:
    positives, negatives = class_counts(df, label)
    return negatives / max(1, positives)


def class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(positive_weight(df, label))).otherwise(F.lit(1.0)))


def _uniform(key: str, seed: int, stream: int):
    """Seeded value in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(stream)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def synthetic_rows(minority: DataFrame, features: Sequence[str], rows: int, k: int = 5, seed: int = 0, key: str = "seq",
                   cell_rows: int = CELL_ROWS) -> DataFrame:
    """`rows` points on segments between a minority row and one of its k nearest minority rows.

    Each synthetic id draws its start row, neighbour and position from a hash of the id, so the
    outcome does not depend on partitioning, and all joins are on evenly drawn keys.
    """
    numbered = land(global_index(minority.select(key, *features), [key], "_start"), "minority")
    count = numbered.count()
    usable = min(k, count - 1)
    if rows <= 0 or usable < 1:
        return minority.sparkSession.createDataFrame([], numbered.select("_start", *features).schema) \
            .withColumnRenamed("_start", "synthetic_id")
    pairs = land(knn_self_join(numbered, features, usable, key, cell_rows), "minority-pairs")
    drawn = minority.sparkSession.range(rows).select(
        F.col("id").alias("synthetic_id"),
        F.floor(_uniform("id", seed, 1) * count).alias("_start"),
        (F.floor(_uniform("id", seed, 2) * usable) + 1).cast("int").alias("rank"),
        _uniform("id", seed, 3).alias("_share"))
    starts = numbered.select(F.col(key), "_start", *[F.col(c).alias(f"_a_{c}") for c in features])
    ends = numbered.select(F.col(key).alias("neighbour_id"), *[F.col(c).alias(f"_b_{c}") for c in features])
    joined = (drawn.join(starts, "_start").join(pairs.select(key, "rank", "neighbour_id"), [key, "rank"])
              .join(ends, "neighbour_id"))
    return joined.select("synthetic_id", *[
        (F.col(f"_a_{c}") + F.col("_share") * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).alias(c) for c in features])


def smote(train: DataFrame, features: Sequence[str], label: str = "label", ratio: float = 0.1, k: int = 5,
          seed: int = 0, key: str = "seq", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Real training rows and int(ratio * negatives - positives) synthetic positives, marked `synthetic`."""
    positives, negatives = class_counts(train, label)
    added = int(ratio * negatives - positives)
    made = synthetic_rows(train.filter(F.col(label) == 1), features, added, k, seed, key, cell_rows)
    return resample_union(train.select(*features, label), made.select(*features), label)


def resample_union(real: DataFrame, made: DataFrame, label: str = "label") -> DataFrame:
    return real.withColumn("synthetic", F.lit(False)).unionByName(
        made.withColumn(label, F.lit(1).cast(real.schema[label].dataType)).withColumn("synthetic", F.lit(True)))


def resample(train: DataFrame, features: Sequence[str], strategy: str, label: str = "label", seed: int = 0,
             key: str = "seq") -> DataFrame:
    """Training rows with a `weight` column under one of the three imbalance strategies."""
    if strategy == "none":
        return train.select(*features, label).withColumn("weight", F.lit(1.0))
    if strategy == "weights":
        return class_weights(train.select(*features, label), label)
    if strategy == "smote":
        return smote(train, features, label, seed=seed, key=key).drop("synthetic").withColumn("weight", F.lit(1.0))
    raise ValueError(f"strategy must be one of {STRATEGIES}")
