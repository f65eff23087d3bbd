import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.learn import anomaly as A
from tallyrisk.learn import attribution as AT
from tallyrisk.learn import calibrate as CA
from tallyrisk.learn import clusters as CL
from tallyrisk.learn import private as DP
from tallyrisk.learn import resample as RS
from tallyrisk.learn import supervised as SU
from tallyrisk.operators import curve as C
from tallyrisk.operators.neighbours import knn_self_join
from tallyrisk.operators.report import REPORT_COLUMNS

NAMES = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def separable(spark):
    """1,500 rows on a spiral of five waves; every 25th is a positive, moved along all of them. Slices take turns of ten."""
    seq = np.arange(1500)
    waves = np.stack([np.sin(seq * (0.37 + 0.21 * d)) + 0.4 * np.cos(seq * seq * (0.011 + 0.003 * d)) for d in range(5)], 1)
    label = (seq % 25 == 7).astype(int)
    data = pd.DataFrame(waves + 1.9 * label[:, None], columns=NAMES).assign(label=label, seq=seq)
    turn = seq // 50 % 10
    data["split"] = np.select([turn < 6, turn < 8], ["train", "val"], "test")
    return spark.createDataFrame(data).repartition(2).persist()


def brute_force(ids, x, k):
    out = {}
    for i, a in zip(ids, x):
        near = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in zip(ids, x) if j != i)[:k]
        out[i] = [(j, pytest.approx(d, abs=1e-9)) for d, j in near]
    return out


def neighbours(spark, ids, x, k, cell_rows):
    data = pd.DataFrame(x, columns=[f"f{d}" for d in range(x.shape[1])]).assign(seq=ids)
    found = knn_self_join(spark.createDataFrame(data).repartition(3), [f"f{d}" for d in range(x.shape[1])], k, cell_rows=cell_rows)
    got = {i: [] for i in ids}
    for r in found.orderBy("seq", "rank").collect():
        got[r["seq"]].append((r["neighbour_id"], r["distance"]))
    return got


@pytest.mark.parametrize("cell_rows", [15, 10000])
def test_knn_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(110, 3)), rng.normal(5, 0.1, size=(40, 3)), rng.integers(0, 3, size=(60, 3))])
    ids = rng.permutation(1000)[:len(x)].tolist()
    assert neighbours(spark, ids, x, 4, cell_rows) == brute_force(ids, x, 4)


def test_knn_when_a_third_of_rows_are_copies(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 2)), np.tile([[0.1, 0.2]], (30, 1))])
    ids = rng.permutation(len(x)).tolist()
    assert neighbours(spark, ids, x, 3, 10) == brute_force(ids, x, 3)


def test_knn_of_a_table_smaller_than_k(spark):
    got = neighbours(spark, [4, 9, 2], np.array([[0.0], [1.0], [5.0]]), 5, 10)
    assert [j for j, _ in got[4]] == [9, 2] and len(got[2]) == 2


def test_resample_without_a_strategy_changes_nothing(spark):
    table = spark.range(12).selectExpr("id * 0.5 a", "cast(id % 5 as double) b", "cast(id % 6 = 0 as int) label")
    out = RS.resample(table, ["a", "b"], "none")
    assert sorted(map(tuple, out.drop("weight").collect())) == sorted(map(tuple, table.collect()))
    assert {r["weight"] for r in out.collect()} == {1.0}
    with pytest.raises(ValueError):
        RS.resample(table, ["a", "b"], "twice")


def test_smote_draws_between_neighbours(spark):
    """Positives sit on a lattice in three columns, so every line between neighbours is known."""
    places = np.array([[i, j, i * j % 3] for i in range(4) for j in range(5)], float)
    seq = np.arange(620)
    x = np.vstack([places, np.stack([np.sin(seq[20:] * f) * 9 for f in (1.3, 2.1, 0.7)], 1)])
    data = pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=(seq < 20).astype(int), seq=seq)
    out = RS.smote(spark.createDataFrame(data), ["a", "b", "c"], cell_rows=6)
    made = out.filter("synthetic").toPandas()
    assert len(made) == int(0.1 * 600 - 20) == 40 and set(made["label"]) == {1}
    near = brute_force(range(20), places, 5)
    for p in made[["a", "b", "c"]].to_numpy():
        off = [np.linalg.norm(np.cross(places[j] - places[i], p - places[i])) / np.linalg.norm(places[j] - places[i]) for i in near for j, _ in near[i]]
        assert min(off) < 1e-6
    again = RS.smote(spark.createDataFrame(data).repartition(6), ["a", "b", "c"], cell_rows=6).filter("synthetic").toPandas()
    assert np.allclose(np.sort(made["a"]), np.sort(again["a"]))


def test_smote_with_one_positive_adds_nothing(spark):
    data = pd.DataFrame({"a": np.arange(100.0), "label": [1] + [0] * 99, "seq": np.arange(100)})
    assert RS.smote(spark.createDataFrame(data), ["a"]).count() == 100


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert sorted(r["weight"] for r in RS.class_weights(df).collect()) == [1.0, 1.0, 1.0, 3.0]


def test_unknown_model_is_refused():
    with pytest.raises(ValueError, match="model must be one of"):
        SU.make_pipeline("perceptron", ["a"], "label", 0, 1.0)


def test_grid_on_separable_data(separable, plain):
    quick = {"logreg": {"maxIter": 30}, "random_forest": {"numTrees": 8, "maxDepth": 5},
             "gbt_depth": {"maxIter": 5, "stepSize": 0.3}, "gbt_leafwise": {"maxIter": 4, "stepSize": 0.3}}
    grid, fitted = SU.model_grid(separable, NAMES, strategies=["none", "weights", "smote"], models=["logreg", "gbt_depth"], overrides=quick)
    rows = grid.collect()
    assert len(rows) == 6 and set(REPORT_COLUMNS) <= set(grid.columns)
    for r in rows:
        assert r["pr_auc"] > (0.8 if r["model"] == "logreg" else 0.6), r
        assert 0 <= r["val_pr_auc"] <= 1
    for t in fitted.values():
        scores = t.score(separable.filter("split = 'test'")).toPandas()["score"]
        assert len(scores) == 300 and scores.between(0, 1).all()
    boosted = fitted["gbt_depth", "none"]
    assert 0 <= boosted.facts["best_iteration"] < 5 and len(boosted.fitted.trees) == boosted.facts["best_iteration"] + 1
    with pytest.raises(TypeError):
        boosted.pipeline  # noqa: B018


def test_scores_of_id_ranges_equal_the_whole(separable, tmp_path):
    t = SU.train("logreg", "none", separable.filter("split = 'train'"), separable.filter("split = 'val'"), NAMES, maxIter=20)
    whole = {r["seq"]: r["score"] for r in SU.batch_predict(t, separable, str(tmp_path / "a")).collect()}
    ranged = SU.range_predict(t, separable, str(tmp_path / "b"), chunks=5)
    assert {r["seq"]: r["score"] for r in ranged.collect()} == whole and len(list((tmp_path / "b").glob("chunk=*"))) == 5


def test_isotonic_and_its_inverse(spark):
    scores, labels = [0.1, 0.2, 0.3, 0.4, 0.6, 0.8], [0, 0, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    model = CA.isotonic_fit(df)
    probe = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.25, 0.3, 0.4, 0.5, 0.9)], "score double")
    got = {r["score"]: r["calibrated"] for r in CA.calibrate(model, probe).collect()}
    assert got == {0.0: 0.0, 0.1: 0.0, 0.25: 0.25, 0.3: 0.5, 0.4: 0.5, 0.5: 0.75, 0.9: 1.0}
    assert CA.calibrator_inverse(spark, model, 0.5).first()[0] == pytest.approx(0.3)
    assert CA.calibrator_inverse(spark, model, 1.5).first()[0] == 1.0
    report = CA.calibration_report(CA.calibrate(model, df)).first()
    assert report["brier_calibrated"] < report["brier_raw"]


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(600, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(seq=np.arange(601)))
    model = A.isolation_forest(df.filter("seq < 600"), ["a", "b"], trees=40, rows=128)
    out = model.score(df).toPandas().sort_values("score")
    assert out["seq"].iloc[-1] == 600 and out["score"].between(0, 1).all()
    again = A.isolation_forest(df.filter("seq < 600").repartition(5), ["a", "b"], trees=40, rows=128).score(df).toPandas()
    assert np.allclose(out.sort_values("seq")["score"], again.sort_values("seq")["score"], atol=0.08)


@pytest.mark.parametrize("n, trees, rows", [(500, 10, 64), (3000, 4, 50), (40, 5, 64)])
def test_tree_samples_have_exact_size(spark, n, trees, rows):
    """The second case deals out one pool, the third has fewer rows than a sample."""
    df = spark.range(n).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("v"))
    sizes = A.tree_samples(df, ["v"], trees, rows, 3).groupBy("tree").agg(F.count("x").alias("n"), F.count_distinct("x").alias("d")).collect()
    assert len(sizes) == trees and {(r["n"], r["d"]) for r in sizes} == {(min(rows, n), min(rows, n))}


def test_grown_trees_cover_their_rows_and_paths_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 3)), 1)  # ties and a column that never varies
    x[:, 2] = 5.0
    trees = [A.grow_tree(x[rng.permutation(700)[:256]], np.random.default_rng(i), 8) for i in range(9)]
    trees.append(A.grow_tree(np.ones((5, 3)), np.random.default_rng(0), 8))  # nothing to split

    def walk(tree, row):
        feature, split, left, right, path = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < split[at] else right[at]
        return path[at]

    rows = np.vstack([x, [[np.nan, 0.0, 5.0]]])
    assert np.allclose(A.path_lengths(trees, rows), [sum(walk(t, r) for t in trees) for r in rows])
    for feature, _, left, right, path in trees[:9]:
        inner = feature >= 0
        assert 2 not in feature and (path[inner] == 0).all() and (path[~inner] > 0).all()
        assert sorted(np.r_[left[inner], right[inner]]) == list(range(1, len(feature)))
    assert trees[9][4].tolist() == [A.average_path(5)] and len(A.path_lengths(trees, rows[:0])) == 0


def test_any_two_trees_share_rows_as_independent_draws_would(spark):
    df = spark.range(4000).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("v"))
    drawn = A.tree_samples(df, ["v"], 12, 1000, 5).toPandas()
    held = [set(v[0] for v in g["x"]) for _, g in drawn.groupby("tree")]
    shared = [len(a & b) for i, a in enumerate(held) for b in held[:i]]
    assert abs(np.mean(shared) - 250) < 8 and max(abs(s - 250) for s in shared) < 60


def test_average_path():
    assert A.average_path(1) == 0 and A.average_path(2) == 1 and 10 < A.average_path(256) < 11


def test_reconstruction_error(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([base, base @ [1.0, 1.0], base @ [1.0, -1.0]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    model = A.recon_error_fit(df, list("abcd"), 2)
    assert model.score(df).agg(F.max("score")).first()[0] < 1e-9  # the data has two dimensions
    off = df.limit(1).withColumn("a", F.col("a") + 5)
    assert model.score(off).first()["score"] > 0.1
    assert len(model.embed(df).first()["embedding"]) == 2


def test_kmeans_and_cluster_features(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, size=(50, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    embedded = A.recon_error_fit(df, ["a", "b"], 2).embed(df)
    model = CL.kmeans_segments(embedded, 3, 3)
    assigned = model.transform(embedded)
    assert sorted(r["count"] for r in assigned.groupBy("cluster").count().collect()) == [50, 50, 50]
    wide, names = CL.one_hot_columns(assigned, 3)
    assert wide.agg(F.sum(sum(F.col(n) for n in names))).first()[0] == 150
    both = CL.append_features(CL.one_hot_vector(assigned, 3), ["a", "b"], "cluster_vector").first()
    assert len(both["all_features"]) == 5 and sum(both["all_features"][2:]) == 1.0


def test_attribution_adds_up(separable):
    t = SU.train("logreg", "none", separable.filter("split = 'train'"), separable.filter("split = 'val'"), NAMES, maxIter=20)
    test = separable.filter("split = 'test'")
    linear = AT.feature_attribution(t, test, separable.filter("split = 'train'"), sample_rows=100).collect()
    assert len(linear) == 5 and linear == sorted(linear, key=lambda r: -r["mean_abs_contribution"])

    def additive(df):
        return df.withColumn("score", F.col("x0") * 3.0 + F.col("x1"))

    walked = {r["feature"]: r["mean_abs_contribution"] for r in
              AT.sampled_attribution(additive, test.limit(50), NAMES, permutations=3).collect()}
    assert walked["x2"] == walked["x3"] == walked["x4"] == 0.0 and walked["x0"] > walked["x1"] > 0


def test_private_accounting():
    assert DP.epsilon_spent(1.0, 1, 1e-5) == pytest.approx(4.5, abs=0.4)
    for target in (8.0, 3.0, 1.0, 0.5):
        noise = DP.noise_for(target, 30, 1e-5)
        assert target * 0.99 < DP.epsilon_spent(noise, 30, 1e-5) <= target
    assert DP.noise_for(0.5, 30, 1e-5) > DP.noise_for(3.0, 30, 1e-5)
    assert DP.epsilon_spent(2.0, 10, 1e-5) < DP.epsilon_spent(2.0, 40, 1e-5)


def test_sampled_accounting_equals_published_values():
    """Share 0.01, noise 4, 10,000 steps, delta 1e-5: epsilon 1.26 by the plain conversion of the moments accountant's paper."""
    plain = min(10_000 * DP.renyi(a, 4.0, 0.01) + math.log(1e5) / (a - 1) for a in range(2, 64))
    assert plain == pytest.approx(1.26, abs=0.01) and DP.epsilon_spent(4.0, 10_000, 1e-5, 0.01) < plain
    # The tighter bound of order 2 and 3 in closed form, and the whole table as the limit.
    q, s = 0.2, 1.5
    assert DP.renyi(2, s, q) == pytest.approx(math.log(1 + q * q * (math.exp(1 / s**2) - 1)))
    assert DP.renyi(3, s, q) == pytest.approx(math.log(1 + 3 * q * q * (1 - q) * (math.exp(1 / s**2) - 1) + q**3 * (math.exp(3 / s**2) - 1)) / 2)
    assert DP.renyi(5, s, 1 - 1e-12) == pytest.approx(DP.renyi(5, s)) and DP.renyi(2.5, s, q) == math.inf
    assert DP.noise_for(1.0, 60, 1e-5, 0.25) < DP.noise_for(1.0, 60, 1e-5)


def test_each_step_draws_rows_by_themselves(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "_row")
    a, b = ({r["_row"] for r in DP.drawn(rows, 0.25, 7, step).collect()} for step in (0, 1))
    assert abs(len(a) - 5000) < 250 and abs(len(a & b) - 1250) < 150
    assert {r["_row"] for r in DP.drawn(rows.repartition(9), 0.25, 7, 0).collect()} == a
    assert DP.drawn(rows, 1.0, 7, 0).count() == 20_000


def test_steps_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1.0, 3.0] + [0.0, 2.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(label=y)).repartition(3)
    got, clipped = DP.dp_train_all(df, ["a", "b"], epsilons=[None, 1e9], steps=8, share=1.0)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(300)])
    for model, clip in ((got, None), (clipped, 1.0)):
        w, v, ratio = np.zeros(3), np.zeros(3), (300 - y.sum()) / y.sum()
        for _ in range(8):
            g = ((1 / (1 + np.exp(-z @ w)) - y) * np.where(y == 1, ratio, 1.0))[:, None] * z
            if clip:
                g /= np.maximum(1.0, np.linalg.norm(g, axis=1))[:, None]
            v = 0.9 * v + g.sum(0) / (300 if clip else 2.0 * (300 - y.sum()))
            w = w - 2.0 * v
        assert np.allclose(model.weights, w, atol=1e-9 if clip is None else 0.02)


def test_private_training_ranks_and_noise_costs(separable, plain):
    train, test = separable.filter("split = 'train'"), separable.filter("split = 'test'")
    auc = {}
    for eps, model in zip((None, 8.0), DP.dp_train_all(train, NAMES, epsilons=(None, 8.0), steps=30)):
        out = model.score(test).toPandas()
        auc[eps] = plain.pr_auc(out["label"].to_numpy(), out["score"].to_numpy())
        assert (model.epsilon is None) == (eps is None)
    assert auc[None] > 0.8 and auc[8.0] > 0.3


def test_clipped_sums_bound_each_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([50.0, 0.0]), pa.array([1.0, 0.0])], names=["x", "y"])
    sums = next(DP._clipped_sums(np.zeros((1, 2)), 10.0, [1.0])(iter([batch])))
    total = np.array([c[0].as_py() for c in sums.columns])
    assert np.linalg.norm(total) <= 2.0 + 1e-12
    assert math.isclose(next(DP._clipped_sums(np.zeros((1, 2)), 1.0, [None])(iter([batch]))).column(0)[0].as_py(), -25.0)


def test_batch_predict(separable, tmp_path):
    t = SU.train("logreg", "none", separable.filter("split = 'train'"), separable.filter("split = 'val'"), NAMES, maxIter=5)
    out = SU.batch_predict(t, separable.filter("split = 'test'"), str(tmp_path / "p"))
    assert out.count() == 300
    assert C.score_curve(out.join(separable, "seq")).count() > 200


def test_knn_in_many_blocks_per_cell(spark, monkeypatch):
    from tallyrisk.operators import neighbours as NB

    monkeypatch.setattr(NB, "QUERY_CHUNK", 16)
    monkeypatch.setattr(NB, "MEMBER_CHUNK", 9)
    x = np.random.default_rng(3).normal(size=(90, 2))
    ids = list(range(90))
    assert neighbours(spark, ids, x, 3, 40) == brute_force(ids, x, 3)


def test_private_training_refuses_missing_features(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (0, None)], "label int, a double")
    with pytest.raises(ValueError, match="2 training rows"):
        DP.dp_train(df, ["a"], epsilon=1.0)
