import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import even_grid
from tallyrisk.operators import cost as K
from tallyrisk.operators import curve as C
from tallyrisk.operators import report as R
from tallyrisk.operators import stream_reports as P
from tallyrisk.operators.quantiles import column_quantiles


def test_ranking_measures_of_a_small_table(scored_frame):
    """Ranks from the top: 1 0 1 1 0 0 0. Precision at the positives is 1/1, 2/3, 3/4; 10 of 12 pairs are in order."""
    curve = C.score_curve(scored_frame([0, 1, 0, 1, 0, 1, 0], [.35, .95, .81, .6, .02, .58, .11]))
    assert C.pr_auc(curve).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert C.roc_auc(curve).first()[0] == pytest.approx(10 / 12)


@pytest.mark.parametrize("cap,recall,threshold", [(0.0, 1 / 3, 0.95), (0.24, 1 / 3, 0.95), (0.25, 1.0, 0.58), (1.0, 1.0, 0.58)])
def test_recall_under_a_cap(scored_frame, cap, recall, threshold):
    row = C.recall_at_fpr(C.score_curve(scored_frame([0, 1, 0, 1, 0, 1, 0], [.35, .95, .81, .6, .02, .58, .11])), cap).first()
    assert (row["recall"], row["threshold"]) == (pytest.approx(recall), threshold)


def test_no_threshold_stays_under_a_cap_of_zero(scored_frame):
    row = C.recall_at_fpr(C.score_curve(scored_frame([0, 1, 1], [.66, .65, .64])), 0.0).first()
    assert (row["recall"], row["threshold"]) == (0.0, math.inf)


def test_recall_counts_whole_tie_groups(scored_frame):
    """Three groups of one positive and two negatives each: a cap of a third admits the first, two thirds the second."""
    curve = C.score_curve(scored_frame([0, 1, 0] * 3, [.4] * 3 + [.3] * 3 + [.2] * 3))
    found = [C.recall_at_fpr(curve, cap).first() for cap in (0.32, 0.34, 0.67)]
    assert [(r["recall"], r["threshold"]) for r in found] == [(0.0, math.inf), (pytest.approx(1 / 3), .4), (pytest.approx(2 / 3), .3)]


def test_confusion_counts_rows_at_the_threshold_as_flagged(scored_frame):
    df = scored_frame([1, 0, 0, 1, 1], [.44, .44, .43, .12, .91])
    at, above = (C.confusion_at_threshold(df, t).first() for t in (.44, .92))
    assert (at["tp"], at["fp"], at["fn"], at["flagged"]) == (2, 1, 1, 3)
    assert at["precision"] == at["recall"] == at["f1"] == pytest.approx(2 / 3, abs=1e-4)
    assert (above["precision"], above["recall"], above["f1"], above["fn"]) == (0.0, 0.0, 0.0, 3)


def test_best_f1_and_its_ties(scored_frame):
    """F1 from the top: 2/3, 1/2, 2/5 for one positive in two at rank 1 and the other at rank 4, where it is 2/3 again."""
    best = C.best_f1_threshold(C.score_curve(scored_frame([0, 1, 1, 0], [.5, .2, .77, .31]))).first()
    assert (best["threshold"], best["f1"]) == (.2, pytest.approx(2 / 3, abs=1e-4))  # the lowest of the tied
    alone = C.best_f1_threshold(C.score_curve(scored_frame([0, 1, 0, 1, 0], [.13, .7, .13, .72, .69]))).first()
    assert (alone["threshold"], alone["f1"]) == (.7, 1.0)


def test_cheapest_threshold_weighs_both_costs(scored_frame):
    """Flagging the middle positive means two reviews more: worth it at 9 a miss, not at 1."""
    df = scored_frame([1, 0, 1, 0, 0, 0], [.9, .8, .7, .2, .2, .1])
    dear, cheap = (K.cheapest(K.cost_curve(C.score_curve(df), {"missed": m, "flagged": 1}, 31)).first() for m in (9, 1))
    assert (dear["missed"], dear["flagged"]) == (0, 3) and (cheap["missed"], cheap["flagged"]) in ((1, 1), (2, 0))


def test_brier_is_the_mean_squared_gap(scored_frame):
    assert R.brier(scored_frame([1, 0, 1], [.5, .5, .8])).first()[0] == pytest.approx((.25 + .25 + .04) / 3)


def test_reliability_bins(scored_frame):
    got = R.reliability_bins(scored_frame([0, 1, 0, 1, 1, 1], [.05, .06, .3, .33, .8, .81]), bins=3).orderBy("bin").collect()
    assert [(r["n"], r["observed"]) for r in got] == [(2, .5), (2, .5), (2, 1.0)] and got[0]["mean_pred"] == pytest.approx(.055)
    assert R.reliability_bins(scored_frame([1, 0, 0, 0], [.25] * 4)).count() == 0


def test_report_of_one_table(scored_frame):
    report = R.full_report(scored_frame([0, 1, 0, 1, 0, 1, 0], [.35, .95, .81, .6, .02, .58, .11]))
    assert tuple(report.columns) == R.REPORT_COLUMNS and report.count() == 1
    assert report.first()["roc_auc"] == pytest.approx(10 / 12, abs=1e-4)


def test_all_scores_tied(scored_frame, plain):
    curve = C.score_curve(scored_frame([0, 1, 0, 0], [0.5] * 4))
    assert C.pr_auc(curve).first()[0] == 0.25 and C.roc_auc(curve).first()[0] == 0.5
    report = R.report_from_curve(curve).first()
    assert (report["flagged"], report["tp"]) == (4, 1)


def test_one_class_only(scored_frame):
    negatives = R.full_report(scored_frame([0, 0, 0], [0.1, 0.2, 0.3])).first()
    assert negatives["pr_auc"] == 0.0 and negatives["roc_auc"] is None and negatives["fn"] == 0
    positives = R.full_report(scored_frame([1, 1], [0.1, 0.2])).first()
    assert positives["pr_auc"] == 1.0 and positives["roc_auc"] is None


def test_one_row_and_no_rows(scored_frame):
    assert R.full_report(scored_frame([1], [0.4])).first()["cost_flagged"] == 1
    assert R.full_report(scored_frame([1], [0.4]).filter("score > 1")).count() == 0


def test_null_and_nan_scores_are_not_ranked(spark):
    df = spark.createDataFrame([(1, 0.9), (0, None), (0, float("nan")), (0, 0.1)], "label int, score double")
    assert C.score_curve(df).count() == 2


def _random(seed, n=900, ties=False):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.05).astype(int)
    s = np.clip(rng.random(n) * 0.8 + 0.15 * y, 0, 1)
    return y, np.round(s, 2) if ties else s


@pytest.mark.parametrize("ties", [False, True])
def test_report_against_numpy(scored_frame, plain, ties):
    y, s = _random(11, ties=ties)
    row = R.full_report(scored_frame(y, s)).first()
    assert row["pr_auc"] == pytest.approx(plain.pr_auc(y, s), abs=6e-5)
    assert row["roc_auc"] == pytest.approx(plain.roc_auc(y, s), abs=6e-5)
    best = min(plain.costs(y, s), key=lambda r: r[1])
    assert row["cost_threshold"] == pytest.approx(best[0], abs=1e-6)
    assert (row["cost_missed"], row["cost_flagged"]) == best[2:] and row["cost_per_10k"] == round(best[1], 2)
    for cap, name in ((0.001, "recall_at_fpr_0_1pct"), (0.01, "recall_at_fpr_1pct")):
        ok = [tp / y.sum() for _, tp, fp in plain.curve(y, s) if fp / (y == 0).sum() <= cap]
        assert row[name] == pytest.approx(max(ok, default=0.0), abs=6e-5)


@pytest.mark.parametrize("ties", [False, True])
def test_cost_curve_against_numpy(scored_frame, plain, ties):
    y, s = _random(5, ties=ties)
    want = plain.costs(y, s)
    got = sorted((r["threshold"], r["cost"], r["missed"], r["flagged"]) for r in K.cost_curve(C.score_curve(scored_frame(y, s))).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == pytest.approx(b[0], abs=1e-12) and a[2:] == b[2:] and a[1] == pytest.approx(b[1])


def test_groups_are_measured_apart(scored_frame, plain):
    y, s = _random(2)
    group = np.arange(len(y)) % 3
    got = {r["g"]: r for r in R.full_report(scored_frame(y, s, g=group), by=["g"]).collect()}
    for g in range(3):
        m = group == g
        assert got[g]["pr_auc"] == pytest.approx(plain.pr_auc(y[m], s[m]), abs=6e-5)
        assert got[g]["cost_per_10k"] == round(min(r[1] for r in plain.costs(y[m], s[m])), 2)


def test_given_thresholds_per_group(spark, scored_frame):
    df = scored_frame([0, 1, 0, 1], [.2, .8, .2, .8], g=["a", "a", "b", "b"])
    at = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "g string, threshold double")
    got = {r["g"]: (r["tp"], r["fp"], r["fn"], r["threshold"]) for r in R.full_report(df, threshold=at, by=["g"]).collect()}
    assert got == {"a": (1, 0, 0, 0.5), "b": (1, 1, 0, 0.1)}


def test_curve_downsample_positions(scored_frame):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 2500), rng.random(2500)
    curve = C.score_curve(scored_frame(y, s))
    points = C.roc_points(curve).orderBy("idx").toPandas()
    keep = np.linspace(0, len(points) - 1, 200).astype(int)
    got = C.curve_downsample(curve).toPandas().sort_values(["fpr", "tpr"]).reset_index(drop=True)
    assert len(got) == 200
    assert np.allclose(got["fpr"], points["fpr"].to_numpy()[keep]) and np.allclose(got["tpr"], points["tpr"].to_numpy()[keep])
    assert got["threshold"][0] == 1.0
    slope = points.to_numpy()[1:-1]
    assert len(slope) < 2500  # runs of one class collapse


def test_every_kth(spark):
    df = spark.range(103).select((F.col("id") * -1).alias("v"))
    assert sorted(r["v"] for r in C.every_kth(df, 4, ["v"]).collect()) == list(range(-102, 1, 4))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    n = 4001
    heavy = np.where(rng.random(n) < 0.4, 3.25, rng.normal(size=n))
    pdf = {"a": rng.normal(size=n), "b": heavy, "c": rng.integers(0, 5, n).astype(float)}
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(pdf)).repartition(3)
    probs = [*even_grid(11), 0.95, 0.99]
    got = column_quantiles(df, ["a", "b", "c"], probs)
    for c, v in pdf.items():
        assert np.allclose(got[c], np.quantile(v, probs), rtol=0, atol=1e-12)


def test_quantiles_survive_a_bad_bracket(spark, monkeypatch):
    """If the approximate bracket misses, the answer is still exact."""
    from tallyrisk.operators import quantiles as N

    monkeypatch.setattr(N, "_bracket_splits", lambda pairs: [float("-inf"), -1.0, -0.5, float("inf")])
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert column_quantiles(df, ["v"], [0.5, 0.9])["v"] == pytest.approx([499.5, 899.1])


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert column_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [1.0, 2.0, 3.0], "b": []}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_metrics_hold_for_any_small_table(scored_frame, plain, rows):
    y, s = np.array([r[0] for r in rows]), np.array([r[1] / 8 for r in rows])
    curve = C.score_curve(scored_frame(y, s))
    if y.sum():
        assert C.pr_auc(curve).first()[0] == pytest.approx(plain.pr_auc(y, s))
    if 0 < y.sum() < len(y):
        assert C.roc_auc(curve).first()[0] == pytest.approx(plain.roc_auc(y, s))
    got = sorted((r["threshold"], r["missed"], r["flagged"]) for r in K.cost_curve(curve, points=7).collect())
    want = [(t, fn, fl) for t, _, fn, fl in plain.costs(y, s, points=7)]
    assert [g[1:] for g in got] == [w[1:] for w in want]


def test_run_reports(spark):
    runs = spark.createDataFrame([("x", 0, 0.7), ("y", 1, 0.9), ("z", 2, 0.9)], "model string, run_idx int, val_pr_auc double")
    assert P.model_select(runs).first()["model"] == "y"
    row = P.seed_stability(runs, "val_pr_auc").first()
    assert row["mean"] == 0.8333 and row["std"] == round(float(np.std([.7, .9, .9])), 4)
    usage = spark.createDataFrame([(2.0, 0.05), (10.0, 0.003)], "quantity double, unit_price double")
    assert P.cost_estimate(usage).first()["total"] == 0.13
