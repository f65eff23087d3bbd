import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.functions import scalars as X
from tallyrisk.operators import drift as D
from tallyrisk.operators import joins as J
from tallyrisk.operators import quality as Q
from tallyrisk.operators.segments import cluster_report


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


def test_psi_against_numpy(spark, plain):
    rng = np.random.default_rng(1)
    ref = {"a": rng.normal(size=2000), "b": rng.integers(0, 4, 2000).astype(float), "c": np.full(2000, 2.0)}
    cur = {"a": rng.normal(0.4, 1.2, 1500), "b": rng.integers(1, 5, 1500).astype(float), "c": rng.normal(size=1500)}
    got = {r["feature"]: r for r in D.feature_drift(frame(spark, **ref), frame(spark, **cur), ["a", "b", "c"]).collect()}
    for c in ("a", "b"):
        assert got[c]["psi"] == round(plain.psi(ref[c], cur[c]), 4)
        assert got[c]["status"] == ("stable" if got[c]["psi"] < 0.1 else "moderate" if got[c]["psi"] < 0.25 else "significant")
    assert got["c"]["psi"] == 0.0  # a constant reference has one bin


def test_same_window_is_stable(spark):
    df = frame(spark, a=np.arange(500.0))
    assert D.psi(df, df, "a").first()["psi"] == 0.0


def test_status_bands_are_half_open(spark):
    df = spark.createDataFrame([("a", 0.09999), ("b", 0.1), ("c", 0.24999), ("d", 0.25)], "feature string, psi double")
    got = {r["feature"]: r["status"] for r in D.with_status(df, None).collect()}
    assert got == {"a": "stable", "b": "moderate", "c": "moderate", "d": "significant"}
    rounded = {r["feature"]: r["status"] for r in D.with_status(df).collect()}
    assert rounded["a"] == "moderate"  # 0.09999 shows as 0.1
    assert D.drift_flagged(D.with_status(df)).count() == 4


def test_summary_and_reference(spark):
    report = spark.createDataFrame([("a", 0.05, "stable"), ("b", 0.3, "significant")], "feature string, psi double, status string")
    assert tuple(D.drift_summary(report).first()) == (2, 0.3, "b", 1)
    ref = D.psi_reference(frame(spark, score=np.linspace(0, 1, 1001))).first()
    assert len(ref["edges"]) == 11 and len(ref["reference"]) == 10
    assert sum(ref["reference"]) == pytest.approx(1.0)


def test_edge_bins_of_long_values(spark):
    edges = spark.createDataFrame([("f", [0.0, 1.0, 2.0]), ("g", [5.0])], "feature string, edges array<double>")
    values = spark.createDataFrame([("f", -9.0), ("f", 0.99), ("f", 1.0), ("f", 7.0), ("g", 3.0)], "feature string, value double")
    got = sorted((r["feature"], r["value"], r["bin"]) for r in J.join_ref_bins(values, edges, 10).collect())
    assert got == [("f", -9.0, 0), ("f", 0.99, 0), ("f", 1.0, 1), ("f", 7.0, 1), ("g", 3.0, 0)]


def good(spark):
    n = 2000
    return frame(spark, V1=np.arange(n, dtype=float), Amount=np.ones(n), label=(np.arange(n) % 100 == 0).astype(int))


def test_valid_table_passes(spark):
    report = Q.require_valid(Q.validate_table(good(spark), ["V1", "Amount"], "label", "Amount"))
    assert {r["check"]: r["value"] for r in report.collect()}["positive_rate"] == 0.01


@pytest.mark.parametrize("change, check", [
    (lambda d: d.drop("V1"), "missing_columns"),
    (lambda d: d.withColumn("V1", F.when(F.col("V1") > 5, F.col("V1"))), "null_features"),
    (lambda d: d.withColumn("V1", F.when(F.col("V1") > 5, F.col("V1")).otherwise(float("nan"))), "null_features"),
    (lambda d: d.withColumn("label", F.when(F.col("V1") == 3, 2).otherwise(F.col("label"))), "binary_target"),
    (lambda d: d.withColumn("label", F.lit(0)), "positive_rate"),
    (lambda d: d.withColumn("label", F.lit(1)), "positive_rate"),
    (lambda d: d.withColumn("Amount", -F.col("Amount")), "negative_amounts"),
])
def test_each_check_fails_alone(spark, change, check):
    report = Q.validate_table(change(good(spark)), ["V1", "Amount"], "label", "Amount")
    assert [r["check"] for r in report.collect() if not r["ok"]] == [check]
    with pytest.raises(Q.ValidationError, match=check):
        Q.require_valid(report)


def test_label_domain(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (None,)], "label int")
    assert {r["label"] for r in Q.label_domain(df).collect()} == {3, None}


def candidate(spark, auc, day):
    return spark.createDataFrame([("m", "none", 0.5, auc, auc, dt.datetime(2024, 1, day))],
                                 "model string, strategy string, threshold double, val_pr_auc double, test_pr_auc double, created_at timestamp")


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "registry")
    with ThreadPoolExecutor(6) as pool:
        got = sorted(pool.map(lambda _: Q.claim_versions(spark, path, 2), range(12)))
    assert all(b - a >= 2 for a, b in zip(got, got[1:])) and got[0] >= 0

    def append(i):
        Q.registry_append(path, spark.createDataFrame(
            [(f"m{i}", "none", 0.5, 0.9, 0.9)], "model string, strategy string, threshold double, val_pr_auc double, test_pr_auc double")
            .withColumn("created_at", F.current_timestamp()))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, range(6)))
    rows = Q.read_registry(spark, path).collect()
    assert len(rows) == len({r["version"] for r in rows}) == len({r["model"] for r in rows}) == 6
    assert [r["version"] for r in rows if r["is_default"]] == [max(r["version"] for r in rows)]


def test_a_registry_without_claims_goes_on(spark, tmp_path):
    path = str(tmp_path / "old")
    one = spark.createDataFrame([("a", "none", 0.5, 0.9, 0.9)], "model string, strategy string, threshold double, val_pr_auc double, test_pr_auc double") \
        .withColumn("created_at", F.current_timestamp())
    Q.next_version(Q.read_registry(spark, path), one).drop("is_default").withColumn("version", F.lit(7).cast("long")).write.parquet(path)
    assert sorted(r["version"] for r in Q.registry_append(path, one).collect()) == [7, 8]


def test_registry_and_gate(spark, tmp_path):
    path = str(tmp_path / "registry")
    empty = Q.read_registry(spark, path)
    assert Q.champion(empty).first()[0] == 0.0
    assert Q.promotion_gate(empty, 0.75).first()["passed"] and not Q.promotion_gate(empty, 0.7499).first()["passed"]
    Q.registry_append(path, candidate(spark, 0.80, 1))
    registry = Q.registry_append(path, candidate(spark, 0.78, 2))
    rows = {r["version"]: r for r in registry.collect()}
    assert rows[2]["is_default"] and not rows[1]["is_default"] and rows[2]["metric_label"] == "0_7800"
    assert Q.champion(registry).first()[0] == 0.78  # the newest, not the best
    assert Q.promotion_gate(registry, 0.776).first()["passed"]
    assert not Q.promotion_gate(registry, 0.7749).first()["passed"]


def test_cluster_report_keeps_empty_clusters(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (2, 0)], "cluster int, label int")
    got = {r["cluster"]: (r["rows"], r["frauds"], r["fraud_rate"], r["lift_vs_base"]) for r in cluster_report(df, 3).collect()}
    assert got == {0: (2, 1, 0.5, 2.0), 1: (0, 0, 0.0, 0.0), 2: (2, 0, 0.0, 0.0)}
    none = cluster_report(df.withColumn("label", F.lit(0)), 3)
    assert none.filter("lift_vs_base is null").count() == 3


def test_scalars(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 0.8017, {"a": 1.5})], "t timestamp, m double, i map<string,double>")
    row = df.select(X.iso_millis(F.col("t")).alias("iso"), X.encode_label_text(F.col("m")).alias("text"),
                    X.decode_label_text(X.encode_label_text(F.col("m"))).alias("back"),
                    X.map_value(F.col("i"), "a").alias("a"), X.map_value(F.col("i"), "b").alias("b"),
                    X.millis_between(X.parse_iso(X.iso_millis(F.col("t"))), F.date_trunc("minute", "t")).alias("ms")).first()
    assert row["iso"] == "2024-01-02T03:04:05.678Z" and (row["text"], row["back"]) == ("0_8017", 0.8017)
    assert (row["a"], row["b"], row["ms"]) == (1.5, 0.0, 5678)
    assert np.allclose(X.decade_grid(-6, 0, 400), np.logspace(-6, 0, 400)) and X.even_grid(400) == np.linspace(0, 1, 400).tolist()
