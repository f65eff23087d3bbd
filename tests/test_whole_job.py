"""Registered model queries do the whole of what they name."""

import inspect
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.learn import boosting as B
from tallyrisk.learn import supervised as SU
from tallyrisk.operators import report as R
from tallyrisk.plans import model_queries as M
from tallyrisk.plans import registry

SF = "/root/testdata/sf0.001"


def asked(spark, monkeypatch, name):
    """The settings that a registered fit gives to `train` beside the tables."""
    told = {}
    monkeypatch.setattr(M, "part", lambda *_: None)
    monkeypatch.setattr(SU, "train", lambda *args, **settings: told.update(inspect.signature(SU_TRAIN).bind(*args, **settings).arguments))
    inspect.unwrap(M._fit)(spark, "an application", SF, name, "none")
    return told


SU_TRAIN = SU.train


def test_depth_boosting_is_registered_with_all_its_rounds(spark, monkeypatch):
    told = asked(spark, monkeypatch, "gbt_depth")
    assert told["name"] == "gbt_depth" and not told.get("overrides") and "patience" not in told
    assert SU.SETTINGS["gbt_depth"]["maxIter"] == 600 and SU.SETTINGS["gbt_depth"]["stepSize"] == 0.05 and B.PATIENCE == 50


def test_leafwise_boosting_is_registered_with_all_its_rounds(spark, monkeypatch):
    told = asked(spark, monkeypatch, "gbt_leafwise")
    assert told["name"] == "gbt_leafwise" and not told.get("overrides") and "patience" not in told
    assert SU.SETTINGS["gbt_leafwise"]["maxIter"] == 600 and SU.SETTINGS["gbt_leafwise"]["numLeaves"] == 31


def test_anomaly_report_makes_all_sixteen_values(spark, monkeypatch):
    """They are written, and the query's columns hang on each of them."""
    data = pd.DataFrame({"label": [0, 1, 0, 1, 0, 0], "seq": range(6), "isolation_forest": [0.2, 0.9, 0.4, 0.3, 0.1, 0.5],
                         "reconstruction": [2.0, 3.0, 0.5, 2.5, 1.0, float("nan")]})
    monkeypatch.setattr(M, "_anomalies", lambda *_: spark.createDataFrame(data))
    landed = {}
    monkeypatch.setattr(M, "land", lambda df, name, **_: landed.setdefault(name, land(df, name)))
    registry.load_all()
    out = registry.QUERIES["anomaly_report"](spark, SF)
    assert {tuple(r) for r in out.collect()} == {(m, 2, 6, True, True, True) for m in ("isolation_forest", "reconstruction")}
    assert set(R.REPORT_COLUMNS) <= set(landed["anomaly-report"].columns)
    sound = landed["anomaly-report"].filter("model = 'isolation_forest'")
    for name in R.REPORT_COLUMNS:
        broken = sound.withColumn(name, F.lit(-1).cast(sound.schema[name].dataType) if name not in ("threshold", "cost_threshold") else F.lit(None).cast("double"))
        row = broken.select(*R.report_checks(F.lit(6))).first()
        assert not (row["ranking"] and row["rates"] and row["costs"]), name


def test_the_grid_is_registered_with_the_settings_of_its_models_and_its_whole_report(spark, monkeypatch):
    told, landed = {}, {}
    values = dict(pr_auc=0.5, roc_auc=0.9, recall_at_fpr_0_1pct=0.2, recall_at_fpr_1pct=0.4, threshold=0.5, precision=0.5, recall=0.5, f1=0.5, flagged=2, tp=1,
                  fp=1, fn=1, cost_threshold=0.5, cost_per_10k=350000.0, cost_missed=1, cost_flagged=2)
    facts = dict(model="gbt_depth", strategy="none", n_train_rows=9, fit_seconds=1.0, best_iteration=3, val_pr_auc=0.5)

    def grid(table, features, **settings):
        told.update(settings)
        return spark.createDataFrame([{**facts, **values}]), {}

    monkeypatch.setattr(SU, "model_grid", grid)
    monkeypatch.setattr(M.W, "transactions", lambda *_: spark.range(6).withColumn("split", F.lit("test")))
    monkeypatch.setattr(M, "land", lambda df, name, **_: landed.setdefault(name, land(df, name)))
    registry.load_all()
    row = registry.QUERIES["model_grid"](spark, SF).first()
    assert not told.get("overrides") and set(R.REPORT_COLUMNS) | {"val_pr_auc", "fit_seconds", "best_iteration"} <= set(landed["grid"].columns)
    assert row["on_val"] and row["ranking"] and row["rates"] and row["positives"] == 2
    assert not row["costs"]  # 350,000 a 10,000 rows is more than flagging all


def test_the_grid_scores_later_rows_in_one_reading(spark, plain, monkeypatch):
    rng = np.random.default_rng(9)
    data = pd.DataFrame(rng.normal(size=(900, 2)).round(1), columns=["a", "b"]).assign(seq=np.arange(900))
    data["label"] = ((data["a"] > 0.5) & (rng.random(900) < 0.7)).astype(int)
    data["split"] = np.select([data["seq"] < 500, data["seq"] < 700], ["train", "val"], "test")
    landed = {}
    monkeypatch.setattr(SU, "land", lambda df, name, *a, **k: landed.setdefault(name, land(df, name, *a, **k)))
    quick = {"logreg": {"maxIter": 20}, "random_forest": {"numTrees": 5, "maxDepth": 3}, "gbt_depth": {"maxIter": 2}}
    grid, fitted = SU.model_grid(spark.createDataFrame(data), ["a", "b"], models=list(quick), strategies=["none", "weights"], overrides=quick)
    assert landed["grid-scores"].count() == 400 and len(landed["grid-scores"].columns) == 2 + 6
    test = data[data["split"] == "test"]
    for r in grid.collect():
        scores = fitted[r["model"], r["strategy"]].score(spark.createDataFrame(test)).toPandas().sort_values("seq")["score"].to_numpy()
        assert r["pr_auc"] == round(plain.pr_auc(test["label"].to_numpy(), scores), 4) and r["tp"] + r["fn"] == test["label"].sum()
    assert grid.count() == 6


def test_fits_that_share_their_start_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame(rng.normal(size=(500, 2)).round(1), columns=["a", "b"]).assign(weight=1.0)
    data["label"] = ((data["a"] > 0.3) & (rng.random(500) < 0.6)).astype(int)
    frame = spark.createDataFrame(data)
    start = B.Binned(frame, frame, ["a", "b"])
    for growth in (B.Growth(leaves=5, row_share=0.8), B.Growth(depth=3, step=0.3)):
        shared, own = (B.Boosting(frame, frame, ["a", "b"], growth, start=s).run(4, None, block=2) for s in (start, None))
        assert shared.measures == own.measures and all(np.array_equal(a.value, b.value) for a, b in zip(shared.trees, own.trees))
    start.close()


def test_many_equal_rows_are_drawn_by_the_binomial_law():
    key = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, 40_000)
    count = np.where(np.arange(40_000) % 2 == 0, 40, 100_000)
    taken = B.drawn(key, count, 3, 2, 0.8)
    for n in (40, 100_000):
        mine = taken[count == n]
        assert abs(mine.mean() - 0.8 * n) < 4 * (0.16 * n / 20_000) ** 0.5 and abs(mine.var() / (0.16 * n) - 1) < 0.05 and mine.max() <= n
    first, steps = B._binomial(20, 0.3)
    assert first == 0 and np.allclose(steps, np.cumsum([math.comb(20, k) * 0.3 ** k * 0.7 ** (20 - k) for k in range(21)]))
    assert np.array_equal(B.drawn(key[::-1], count[::-1], 3, 2, 0.8)[::-1], taken)


def test_histograms_added_by_tasks_equal_those_added_by_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.normal(size=(400, 2)), columns=["a", "b"]).assign(label=(rng.random(400) < 0.3).astype(int))
    frame = spark.createDataFrame(data)
    monkeypatch.setattr(B, "LEAST_ROWS", 64)
    fits = []
    for most in (32, 2):
        monkeypatch.setattr(B, "DIRECT", most)
        fits.append(B.Boosting(frame, frame, ["a", "b"], B.Growth(leaves=7, row_share=0.8)).run(2, None))
    assert fits[0]._train.getNumPartitions() > 2
    for a, b in zip(*(f.trees for f in fits)):
        assert np.array_equal(a.value, b.value) and np.array_equal(a.bin, b.bin) and len(a.value) == 13


def test_only_wanted_leaves_are_walked_to():
    tree = B.Tree(np.array([0, -1, 1, -1, -1]), np.array([3, 0, 2, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.zeros(5), np.zeros(5))
    columns = [np.arange(8, dtype=np.uint8), np.array([0, 1, 2, 3, 0, 1, 4, 5], np.uint8)]
    every = B.rows_by_node(tree, columns, np.arange(8))
    assert {k: sorted(v.tolist()) for k, v in every.items()} == {1: [0, 1, 2, 3], 3: [4, 5], 4: [6, 7]}
    some = B.rows_by_node(tree, columns, np.arange(8), [4])
    assert list(some) == [4] and sorted(some[4].tolist()) == [6, 7]
