import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.learn import boosting as B
from tallyrisk.learn import supervised as SU
from tallyrisk.learn.boosting import Boosting, Growth

NAMES = ["a", "b", "c"]


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 30, n).astype(float), rng.exponential(size=n)])
    odds = 2 * (x[:, 0] > 0.4) * (x[:, 1] > 12) + np.sin(3 * x[:, 2]) - 1.2
    return pd.DataFrame(x, columns=NAMES).assign(label=(rng.random(n) < 1 / (1 + np.exp(-odds))).astype(int), weight=1.0 + (np.arange(n) % 3), seq=np.arange(n))


def plain_tree(x, g, h, growth):
    """Leaf-wise by its definition: keep the rows of every leaf, try every cut of all, split the best one, begin again."""
    leaves, splits = [(np.arange(len(x)), 0)], []

    def cuts(mine):
        best = (0.0, None)
        total = g[mine].sum() ** 2 / (h[mine].sum() + growth.l2)
        for f in range(x.shape[1]):
            for v in np.unique(x[mine, f])[:-1]:
                left = x[mine, f] <= v
                sides = [mine[left], mine[~left]]
                if min(map(len, sides)) < growth.min_rows or min(h[s].sum() for s in sides) < growth.min_curvature:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + growth.l2) for s in sides) - total
                if gain > best[0] + 1e-9:
                    best = gain, (f, v, *sides)
        return best

    known = {}
    while growth.leaves is None or len(leaves) < growth.leaves:
        for i, (mine, depth) in enumerate(leaves):
            if mine.tobytes() not in known:
                known[mine.tobytes()] = cuts(mine) if growth.depth is None or depth < growth.depth else (0.0, None)
        at = max(range(len(leaves)), key=lambda i: known[leaves[i][0].tobytes()][0])
        gain, cut = known[leaves[at][0].tobytes()]
        if cut is None:
            break
        mine, depth = leaves.pop(at)
        splits.append((cut[0], cut[1], len(mine)))
        leaves += [(cut[2], depth + 1), (cut[3], depth + 1)]
    return leaves, splits


@pytest.mark.parametrize("growth", [Growth(leaves=31, min_rows=5, step=0.3), Growth(depth=3, min_curvature=1.0, l2=1.0, step=0.3)])
def test_trees_equal_a_plain_fit(spark, growth, monkeypatch):
    data = rows(700)
    data["a"] = (data["a"] * 20).round() / 20
    data["c"] = (data["c"] * 20).round() / 20
    # Every value has a bin of its own, rare ones too.
    monkeypatch.setattr(B, "bin_edges", lambda df, features: [np.unique(data[c])[:-1] for c in features])
    frame = spark.createDataFrame(data).repartition(5)
    fit = Boosting(frame, frame.limit(200), NAMES, growth).run(3, None)
    x, y, w = data[NAMES].to_numpy(), data["label"].to_numpy(), data["weight"].to_numpy()
    margin = np.full(len(x), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for tree in fit.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves, splits = plain_tree(x, g, h, growth)
        inner = tree.feature >= 0
        got = sorted((f, float(fit.edges[f][b]), int(n)) for f, b, n in zip(tree.feature[inner], tree.bin[inner], tree.cover[inner]))
        assert got == sorted(splits) and len(leaves) == (~inner).sum()
        for mine, _ in leaves:
            margin[mine] -= growth.step * g[mine].sum() / (h[mine].sum() + growth.l2)
        if growth.leaves:
            assert len(leaves) == 31 and max(d for _, d in leaves) > 5
    assert np.allclose(fit.model(3).margins(list(x.T)), margin, atol=1e-5)
    assert np.allclose([r["s"] for r in fit.model(3).score(frame, "s").orderBy("seq").collect()], 1 / (1 + np.exp(-margin)), atol=1e-5)


def test_rounds_go_on_from_carried_margins_and_partitions_do_not_matter(spark, plain):
    data, growth = rows(900), Growth(leaves=8, min_rows=5, step=0.2, row_share=0.7, feature_share=0.67)
    train, val = spark.createDataFrame(data[:600]), spark.createDataFrame(data[600:])
    once = Boosting(train.repartition(7), val, NAMES, growth).run(7, None)
    twice = Boosting(train.repartition(1), val.repartition(3), NAMES, growth).run(3, None, block=2).run(4, None, block=3)
    for a, b in zip(once.trees, twice.trees):
        assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "bin", "left", "right", "value", "cover"))
    assert once.measures == twice.measures and len(once.trees) == 7
    values = [data[c][600:].to_numpy() for c in NAMES]
    for n in (1, 4, 7):
        assert once.measures[n - 1] == pytest.approx(plain.pr_auc(data["label"][600:].to_numpy(), once.model(n).margins(values)), abs=1e-9)
    assert len({t.cover[0] for t in once.trees}) > 1 and all(350 < t.cover[0] < 490 for t in once.trees)


def test_boosting_stops_when_the_best_round_is_far_back(spark):
    data = rows(400)
    noise = spark.createDataFrame(data[300:].assign(label=(np.arange(100) % 7 == 0).astype(int)))
    fit = Boosting(spark.createDataFrame(data[:300]), noise, NAMES, Growth(leaves=6, step=0.9)).run(40, patience=3, block=2)
    assert len(fit.trees) < 40 and len(fit.trees) - fit.best_rounds >= 3 and len(fit.close().trees) == fit.best_rounds


def test_saved_models_score_alike(spark, tmp_path):
    data = rows(300)
    frame = spark.createDataFrame(data)
    for name, settings in (("gbt_leafwise", {"numLeaves": 5}), ("gbt_depth", {"maxDepth": 2})):
        t = SU.train(name, "weights", frame, frame, NAMES, maxIter=2, **settings)
        t.save(spark, str(tmp_path / name))
        back = SU.Classifier.load(spark, str(tmp_path / name), NAMES, **t.facts).fitted
        values = [data[c].to_numpy() for c in NAMES]
        assert np.array_equal(back.margins(values), t.fitted.margins(values)) and back.features == NAMES


def test_odd_rows(spark):
    """Missing values count as the largest; one class, equal rows and empty slices give a model of no splits."""
    data = rows(200).astype({"a": object})
    data.loc[:60, "a"] = None
    frame = spark.createDataFrame(data.assign(a=data["a"].astype(float)))
    fit = Boosting(frame, frame, NAMES, Growth(leaves=4)).run(2, None)
    out = fit.model(2).score(frame.withColumn("a", F.when(F.col("a").isNotNull() & ~F.isnan("a"), F.col("a")))).toPandas()
    assert out["score"].between(0, 1).all() and len(out) == 200
    high = fit.model(2).margins([np.array([np.nan, 1e30]), np.array([3.0, 3.0]), np.array([0.1, 0.1])])
    assert high[0] == high[1]
    for odd in (frame.withColumn("label", F.lit(0)), frame.withColumns({c: F.lit(1.0) for c in NAMES}), frame.limit(0)):
        fit = Boosting(odd, frame, NAMES, Growth(leaves=4)).run(1, None)
        assert len(fit.trees[0].feature) == 1 and np.isfinite(fit.trees[0].value[0]) and fit.model(1).score(frame).count() == 200
    assert Boosting(frame, frame.limit(0), NAMES, Growth(leaves=4)).run(1).measures == [0.0] and B.MOST_BINS == 255
