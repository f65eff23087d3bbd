import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import joins as J
from tallyrisk.operators.order import global_index, index_within, running_totals


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(5000, numPartitions=7).select(F.xxhash64("id").alias("v"), "id")
    got = global_index(df, ["v"]).orderBy("v").toPandas()
    assert got["seq"].tolist() == list(range(5000))


def test_global_index_spreads_one_repeated_value(spark):
    df = spark.range(4000, numPartitions=4).select(F.lit(7).alias("v"), "id")
    placed = global_index(df, ["v"])
    assert sorted(r["seq"] for r in placed.collect()) == list(range(4000))
    assert len(placed.inputFiles()) > 1


def test_index_within_groups(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("b", 9), ("a", 2)], "g string, v int")
    got = {(r["g"], r["v"]): r["idx"] for r in index_within(df, ["g"], ["v"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0, ("b", 9): 1}


@pytest.mark.parametrize("batch", [7, 10000])
def test_running_totals_across_ranges_and_batches(spark, batch):
    """One group holds most rows and spans several ranges; batches end inside and between groups."""
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"g": np.where(rng.random(3000) < 0.8, "big", rng.choice(list("abc"), 3000)),
                         "t": rng.permutation(3000), "x": rng.integers(0, 9, 3000), "y": rng.integers(0, 5, 3000), "w": rng.random(3000)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = running_totals(spark.createDataFrame(data).repartition(5), "g", [F.col("t").asc()], ["x", "y"], ["x", "y", "w"]).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = data.sort_values(["g", "t"]).reset_index(drop=True)
    got = got.sort_values(["g", "t"]).reset_index(drop=True)
    by = want.groupby("g")
    for c in ("x", "y"):
        assert (got[f"run_{c}"] == by[c].cumsum()).all()
        assert (got[f"all_{c}"] == by[c].transform("sum")).all()
    for c in ("x", "y", "w"):
        assert got[f"next_{c}"].fillna(-1).tolist() == by[c].shift(-1).fillna(-1).tolist()
    assert (got["place"] == by.cumcount()).all()
    assert (got["places"] == by["x"].transform("size")).all()


def test_running_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, t int, x long")
    assert running_totals(empty, "g", [F.col("t").asc()], ["x"]).count() == 0


def test_balanced_join_keeps_every_row_of_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = J.balanced_join(many, one, ["k"], rows_per_task=130)
    want = many.join(one, "k")
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.count() == want.count() == 3000


def test_left_balanced_join_keeps_unmatched(spark):
    many = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")], "k int, v string")
    one = spark.createDataFrame([(1, 5)], "k int, w int")
    got = J.balanced_join(many, one, ["k"], "left", rows_per_task=7)
    assert got.count() == 51 and got.filter("w is null").count() == 1


def test_missing_and_duplicates(spark):
    expected = spark.range(10).withColumnRenamed("id", "event_id")
    scored = spark.createDataFrame([(0,), (1,), (1,), (1,), (5,)], "event_id long")
    missing = sorted(r[0] for r in J.missing_after_stream(expected, scored).collect())
    assert missing == [2, 3, 4, 6, 7, 8, 9]
    assert tuple(J.duplicate_count(scored).first()) == (5, 3, 2)
    assert tuple(J.duplicate_count(scored.filter("event_id < 0")).first()) == (0, 0, 0)


def test_score_agreement_sees_one_bad_copy(spark):
    local = spark.createDataFrame([(1, 0.2), (2, 0.9)], "event_id long, score double")
    remote = spark.createDataFrame([(1, 0.2, False), (1, 0.7, True), (2, 0.9, True)], "event_id long, score double, is_alert boolean")
    row = J.score_agreement(remote, local, 0.5).first()
    assert row["rows"] == 3 and row["max_abs_score_diff"] == pytest.approx(0.5) and row["alerts_identical"] is False
