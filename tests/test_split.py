import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import split as S
from tallyrisk.sources.transactions import CARD_FEATURES, project_features, scan_transactions


def ledger(spark, n, step=1):
    """n rows out of order, `seq` in steps of `step`, every 9th a positive, three amounts."""
    return (spark.range(n).selectExpr(f"(id * 7919 % {n}) * {step} seq", "id % 9 = 4 positive", "id % 3 * 2.5 amount")
            .select("seq", F.col("positive").cast("int").alias("Class"), "amount").repartition(5))


def test_later_slices_come_later(spark):
    for df in (ledger(spark, 907), ledger(spark, 907, 31)):
        edges = {r["split"]: (r["low"], r["high"], r["n"]) for r in S.time_split(df).groupBy("split").agg(
            F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")).collect()}
        assert edges["train"][1] < edges["val"][0] and edges["val"][1] < edges["test"][0]
        assert [edges[s][2] for s in ("train", "val", "test")] == [634, 91, 182]


def test_gaps_do_not_change_the_split(spark):
    dense = {r["seq"]: r["split"] for r in S.time_split(ledger(spark, 250), dense=True).collect()}
    sparse = S.time_split(ledger(spark, 250).withColumn("seq", F.col("seq") * F.col("seq") * F.col("seq") - 5000))
    assert sorted(r["split"] for r in sparse.collect()) == sorted(dense.values())
    assert {round((r["seq"] + 5000) ** (1 / 3)): r["split"] for r in sparse.collect()} == dense


def test_rows_tied_at_a_cut_are_shared_out(spark):
    df = spark.range(100).selectExpr("case when id < 10 then id when id < 90 then 50 else id end seq", "id")
    sizes = {r["split"]: r["count"] for r in S.time_split(df).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20} and S.time_split(df).select("id").distinct().count() == 100
    assert S.head_n(df, 33).count() == 33 and S.head_n(df, 0).count() == 0 and S.head_n(df, 1000).count() == 100


def test_other_orderable_columns_are_numbered(spark):
    df = spark.range(40).selectExpr("concat('k', lpad(id, 3, '0')) seq")
    assert sorted(r["seq"] for r in S.head_n(df, 3).collect()) == ["k000", "k001", "k002"]


@pytest.mark.parametrize("n,cuts", [(1000, (700, 799)), (907, (634, 725)), (284807, (199364, 227845)), (10, (7, 7)), (0, (0, 0))])
def test_cuts_truncate_float_products(n, cuts):
    assert S.split_points(n) == cuts


def test_value_at_narrows_wide_ranges(spark):
    df = spark.range(1000).selectExpr("id * 9007199254740 - 4000000000000000 v")
    assert S.value_at(df, 0, "v") == (-4000000000000000, 0)
    assert S.value_at(df, 617, "v") == (617 * 9007199254740 - 4000000000000000, 617) and S.value_at(df, 1000, "v") is None


def test_feature_order_is_declared_order(spark):
    row = spark.range(1).select(*[F.lit(float(i)).alias(c) for i, c in enumerate(reversed(CARD_FEATURES))])
    assert len(CARD_FEATURES) == 29 and project_features(row).columns == CARD_FEATURES
    assert list(project_features(row).first()) == [float(i) for i in range(28, -1, -1)]


def test_summary_counts(spark):
    rows = {r["split"]: r for r in S.split_summary(S.time_split(ledger(spark, 907), dense=True), "Class").collect()}
    assert sum(r["rows"] for r in rows.values()) == 907 and sum(r["frauds"] for r in rows.values()) == 101
    assert (rows["train"]["seq_from"], rows["train"]["seq_to"], rows["test"]["seq_to"]) == (0, 633, 906)
    assert rows["val"]["fraud_rate"] == round(rows["val"]["frauds"] / 91, 6)


def test_prefix_and_halves(spark):
    assert sorted(r["seq"] for r in S.time_prefix_sample(ledger(spark, 300, 4), 0.05).collect()) == list(range(0, 60, 4))
    gaps = spark.range(101).selectExpr("id * id seq")
    halves = {r["half"]: (r["n"], r["top"]) for r in S.split_halves(gaps).groupBy("half").agg(F.count("*").alias("n"), F.max("seq").alias("top")).collect()}
    assert halves == {"first": (50, 49 * 49), "second": (51, 10000)}
    assert sorted(r["seq"] for r in S.head_n(gaps.filter("seq > 400"), 3).collect()) == [441, 484, 529]


def test_fixed_sample_does_not_depend_on_partitions(spark):
    df = ledger(spark, 5000)
    drawn = [{r["seq"] for r in S.random_sample_fixed(d, 37, seed=5).collect()} for d in (df, df.repartition(11), df.coalesce(1))]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 37
    assert S.random_sample_fixed(df, 6000).count() == 5000 and S.random_sample_fixed(df, 0).count() == 0
    assert S.random_sample_fixed(df.withColumn("seq", F.lit(3)), 20).count() == 20  # one hash for all rows


def test_scan_numbers_rows_in_file_order(spark, tmp_path):
    """Three files of unlike size; Spark packs the larger ones first."""
    for part, (low, high) in enumerate([(0, 40), (40, 9000), (9000, 11000)]):
        spark.range(low, high, numPartitions=1).selectExpr("id place", "cast(id % 2 as string) Class", "repeat(uuid(), 20) pad").write.parquet(f"{tmp_path}/t/p={part}")
    got = scan_transactions(spark, f"{tmp_path}/t")
    assert got.filter("seq <> place").count() == 0 and got.count() == 11000 and dict(got.dtypes)["Class"] == "int"


def test_scan_orders_by_columns_or_keeps_its_own(spark, tmp_path):
    spark.range(50).selectExpr("(id * 13 % 50) a", "0 Class").write.parquet(f"{tmp_path}/t")
    assert [r["a"] for r in scan_transactions(spark, f"{tmp_path}/t", order=["a"]).orderBy("seq").collect()] == list(range(50))
    spark.range(5).selectExpr("id + 100 seq", "0 Class").write.parquet(f"{tmp_path}/u")
    assert sorted(r["seq"] for r in scan_transactions(spark, f"{tmp_path}/u").collect()) == [100, 101, 102, 103, 104]


def test_cuts_order_only_the_rows_tied_there(spark):
    df = spark.range(997).selectExpr("id * 7919 % 997 AS id", "id * 7919 % 997 div 60 * 86400000000 AS moment", "id * 31 % 997 AS other").repartition(4)
    plain = [r["id"] for r in df.orderBy("moment", "other").collect()]
    want = {x: "train" if i < 697 else "val" if i < 797 else "test" for i, x in enumerate(plain)}
    assert {r["id"]: r["split"] for r in S.time_split(df, seq="moment", ties=["other"]).collect()} == want
    assert S.value_at(df, 0, "moment") == (0, 0) and S.value_at(df, 996, "moment") == (16 * 86400000000, 960)
