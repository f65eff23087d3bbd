from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.learn import attribution as AT
from tallyrisk.learn import supervised as SU
from tallyrisk.learn.shapley import Node, contributions, leaves_of


def random_tree(rng, width, depth):
    nodes = []

    def grow(left_depth, cover):
        at = len(nodes)
        if left_depth == 0 or cover < 2 or rng.random() < 0.15:
            nodes.append(Node(-1, 0.0, -1, -1, float(rng.normal()), float(cover)))
            return at
        nodes.append(None)
        part = int(rng.integers(0, cover + 1))  # a side may be empty
        feature, threshold = int(rng.integers(width)), float(rng.normal())
        nodes[at] = Node(feature, threshold, grow(left_depth - 1, part), grow(left_depth - 1, cover - part), 0.0, float(cover))
        return at

    grow(depth, 64)
    return nodes


def expected(nodes, x, known, at=0):
    n = nodes[at]
    if n.feature < 0:
        return n.value
    goes = n.left if (np.inf if np.isnan(x[n.feature]) else x[n.feature]) <= n.threshold else n.right
    if n.feature in known:
        return expected(nodes, x, known, goes) if nodes[goes].cover else 0.0
    return sum(nodes[c].cover / n.cover * expected(nodes, x, known, c) for c in (n.left, n.right) if nodes[c].cover)


def enumerated(nodes, x, width):
    out = np.zeros(width)
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for size in range(width):
            weight = factorial(size) * factorial(width - 1 - size) / factorial(width)
            for known in combinations(others, size):
                out[i] += weight * (expected(nodes, x, {*known, i}) - expected(nodes, x, set(known)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_average_over_all_feature_sets(seed):
    rng = np.random.default_rng(seed)
    width, trees = 5, [random_tree(rng, 5, depth) for depth in (0, 1, 3, 7)]
    x = rng.normal(size=(9, width))
    x[3, 2] = np.nan
    leaves = leaves_of(trees, width, start=0.5)
    got = leaves.values(x)
    for row, found in zip(x, got):
        assert np.allclose(found, sum(enumerated(t, row, width) for t in trees), atol=1e-10)
        assert np.isclose(leaves.base + found.sum(), 0.5 + sum(expected(t, row, set(range(width))) for t in trees), atol=1e-10)


def test_blocks_do_not_matter(monkeypatch):
    from tallyrisk.learn import shapley as SH

    rng = np.random.default_rng(9)
    leaves, x = leaves_of([random_tree(rng, 4, 6) for _ in range(5)], 4), rng.normal(size=(50, 4))
    whole = leaves.values(x)
    monkeypatch.setattr(SH, "BLOCK_LEAVES", 7)
    monkeypatch.setattr(SH, "CELLS", 60)
    assert np.allclose(leaves.values(x), whole, atol=1e-12)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + rng.normal(scale=0.4, size=1500) > 0.8).astype(int)
    frame = pd.DataFrame(x, columns=list("abcd")).assign(label=y, seq=np.arange(1500), split=np.where(np.arange(1500) < 1000, "train", "val"))
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("name, settings", [("random_forest", {"numTrees": 12, "maxDepth": 6}), ("gbt_depth", {"maxIter": 6, "stepSize": 0.3}),
                                            ("gbt_leafwise", {"maxIter": 4, "stepSize": 0.3})])
def test_contributions_add_up_to_the_score(rows, name, settings):
    model = SU.train(name, "weights", rows.filter("split = 'train'"), rows.filter("split = 'val'"), list("abcd"), **settings)
    val = rows.filter("split = 'val'")
    if name != "random_forest":
        val = val.withColumn("d", F.when(F.col("seq") % 50 == 0, F.lit(None)).otherwise(F.col("d")))
    got = AT.tree_contributions(model, val).join(model.score(val).select("seq", "score"), "seq").toPandas()
    total = got["base"] + got["contributions"].map(sum)
    told = total if name == "random_forest" else 1 / (1 + np.exp(-total))
    assert len(got) == 500 and np.allclose(told, got["score"], atol=1e-10)
    first = AT.feature_attribution(model, rows.filter("split = 'val'"), rows, sample_rows=200).first()
    assert first["feature"] in "ab"


def test_tables_without_rows_and_models_without_splits(spark):
    leaves = leaves_of([[Node(-1, 0.0, -1, -1, 2.5, 10.0)]], 2)
    df = spark.createDataFrame([(1, 0.5, None)], "seq long, a double, b double")
    got = contributions(df, leaves, ["a", "b"]).collect()
    assert [(r["seq"], r["contributions"], r["base"]) for r in got] == [(1, [0.0, 0.0], 2.5)]
    assert contributions(df.limit(0), leaves, ["a", "b"]).count() == 0
