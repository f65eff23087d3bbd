import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.learn import boosting as B
from tallyrisk.learn import forest as FO
from tallyrisk.learn import supervised as SU

NAMES = ["a", "b", "c", "d"]


def coarse(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] > 1) & (rng.random(n) < 0.7)).astype(int)
    return pd.DataFrame(x, columns=NAMES).assign(label=y, weight=1.0 + 2.0 * y, seq=np.arange(n))


def test_fits_read_distinct_rows(spark):
    data = coarse(6000)
    frame = spark.createDataFrame(data).repartition(4)
    edges = B.bin_edges(frame, NAMES)
    table = B.packed(frame, NAMES, edges, "label", "weight", -1.0).toPandas()
    counted = data.groupby([*NAMES, "label"]).size()
    assert len(table) == len(counted) < 2600 and table["n"].sum() == 6000 and sorted(table["n"]) == sorted(counted)
    trees = [B.Boosting(frame.repartition(k), frame, NAMES, B.Growth(leaves=6, row_share=0.8)).run(2, None).trees for k in (1, 9)]
    assert all(np.array_equal(p.value, q.value) for p, q in zip(*trees)) and abs(trees[0][0].cover[0] / 6000 - 0.8) < 0.03


def test_draws_follow_the_law_of_single_rows():
    key = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 3000)
    for n in (1, 7, 300):
        count = np.full(3000, n)
        taken = B.drawn(key, count, 0, 1, 0.3)
        assert taken.max() <= n and abs(taken.mean() / (0.3 * n) - 1) < 0.06 and abs(taken.var() / (0.21 * n) - 1) < 0.15
        times = FO.draws(key, count, 4, 0)
        assert abs(times.mean() / n - 1) < 0.05 and abs(times.var() / n - 1) < 0.1 and abs(np.corrcoef(times.T)[0, 1]) < 0.08
    assert (B.drawn(key, count, 0, 1, 1.0) == count).all()


def test_best_cuts_against_every_cut():
    rng = np.random.default_rng(2)
    found = rng.integers(0, 9, (20, 3, 5, 3)).astype(float)
    found[..., 0] = found[..., 1] + found[..., 2]
    gain, k, b, left, right = FO.best_cuts(found, 4)
    gini = lambda s: (s[1] + s[2]) * (1 - sum((c / (s[1] + s[2])) ** 2 for c in s[1:])) if s[1] + s[2] else 0.0
    for i, node in enumerate(found):
        cuts = [(gini(f.sum(0)) - gini(f[:c + 1].sum(0)) - gini(f[c + 1:].sum(0)), -j, -c) for j, f in enumerate(node) for c in range(4)
                if min(f[:c + 1, 0].sum(), f[c + 1:, 0].sum()) >= 4]
        assert gain[i] == pytest.approx(max(cuts)[0]) and np.allclose(left[i], node[k[i], :b[i] + 1].sum(0)) and np.allclose(left[i] + right[i], node[k[i]].sum(0))


def test_forest_finds_the_rule_and_grows_as_asked(spark, tmp_path, monkeypatch):
    data = coarse(4000)
    frame = spark.createDataFrame(data).repartition(3)
    settings = {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 2}
    model = SU.train("random_forest", "weights", frame, frame, NAMES, **settings)
    x = data[NAMES].to_numpy()
    inside = (x[:, 0] > 2) & (x[:, 1] > 1)
    told = model.score(frame).orderBy("seq").toPandas()["score"].to_numpy()
    w = (data["label"] == 0).sum() / (data["label"] == 1).sum()
    share = data["label"][inside].mean()
    assert told[inside].mean() == pytest.approx(w * share / (w * share + 1 - share), abs=0.03) and told[~inside].max() < 0.3
    assert np.allclose(model.fitted.margins(list(x.T)), told)
    for tree in model.fitted.trees:
        deep = np.zeros(len(tree.feature), int)
        for i in np.flatnonzero(tree.feature >= 0):
            deep[[tree.left[i], tree.right[i]]] = deep[i] + 1
        assert deep.max() <= 6 and (tree.feature >= 0).sum() > 1
    again = SU.train("random_forest", "weights", frame.repartition(7), frame, NAMES, **settings)
    monkeypatch.setattr(FO, "KNOWN_ROWS", 40)
    assert np.allclose(FO.Known(again.fitted).scores(list(x.T)), told)
    model.save(spark, str(tmp_path / "forest"))
    back = SU.Classifier.load(spark, str(tmp_path / "forest"), NAMES, **model.facts)
    assert np.array_equal(back.fitted.margins(list(x.T)), model.fitted.margins(list(x.T)))


def test_passes_in_parts_and_odd_rows(spark, monkeypatch):
    frame = spark.createDataFrame(coarse(500))
    monkeypatch.setattr(FO, "PASS_BYTES", 3 * 2 * 32 * 3 * 8)  # three nodes a pass
    small = FO.random_forest(frame, NAMES, FO.Forestry(numTrees=4, maxDepth=3), seed=1)
    assert all((t.feature >= 0).sum() > 2 for t in small.trees)
    monkeypatch.undo()
    for odd in (frame.withColumn("label", F.lit(0)), frame.withColumns({c: F.lit(1.0) for c in NAMES}), frame.limit(0)):
        model = FO.random_forest(odd, NAMES, FO.Forestry(numTrees=3))
        assert all(len(t.feature) == 1 for t in model.trees) and model.score(frame).filter("score between 0 and 1").count() == 500
