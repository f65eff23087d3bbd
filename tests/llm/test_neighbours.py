import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.llm.neighbours import VantageTree, nearest


def plain(ids, vectors, queries, k):
    out = {}
    for q in queries:
        score = (vectors[ids.tolist().index(q)][None] * vectors).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).repartition(3)


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_factor_one_is_exact(spark, spread):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(500, 6)) * rng.uniform(0.5, 2, (500, 1))).astype(np.float32)
    v[100:260] = v[7]  # a value shared by a third of the rows
    v[300:] = v[300:] * np.float32(spread) + np.float32(0.25)
    ids = np.arange(500) * 5
    got = {}
    for r in nearest(table_of(spark, [(int(i), [float(x) for x in row], 0) for i, row in zip(ids, v)]), F.col("id") % 20 == 0, k=7,
                     factor=1.0, shard_values=900, block_values=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = plain(ids, v.astype(np.float64), [i for i in ids if i % 20 == 0], 7)
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()} == expected


def test_rows_that_take_no_part(spark):
    good = [(20 * i, [float(i), 1.0], 0) for i in range(4)]
    bad = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [None, 1.0], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (None, [9.0, 9.0], 0),
           (7, [5.0, 5.0, 5.0], 0), (20, [1.0, 1.0], 1)]
    got = nearest(table_of(spark, good + bad), F.col("id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20) == [
        (20, n, i) for n, i in ((1, 60), (2, 40), (3, 0)) for _ in range(2)]
    assert len(got) == 18 and nearest(table_of(spark, []), F.col("id") % 20 == 0).count() == 0
    assert nearest(table_of(spark, good[1:2]), F.col("id") % 20 == 0).count() == 0


def test_recall_of_the_default_factor(spark):
    from tallyrisk.llm.common import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    expected = plain(ids, v, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in QUERIES["op4_vantage_trees"](spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    recall = [len(got[q].keys() & {i for i, _ in best}) / 20 for q, best in expected.items()]
    assert got.keys() == expected.keys() and np.mean(recall) >= 0.95


def test_tree_of_equal_rows_is_one_leaf():
    tree = VantageTree(np.arange(300), np.ones((300, 3)))
    ids, score = tree.search(np.array([-5]), np.ones((1, 3)), 4, 1.0)
    assert ids.tolist() == [[0, 1, 2, 3]] and np.allclose(score, 3)


def test_rows_that_share_an_id_all_take_part(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(240, 5)).astype(np.float32)
    ids = rng.integers(0, 60, 240)
    ids[:80] = 40  # one id holds a third of the rows
    v[200:210] = v[10]
    got = {}
    for r in nearest(table_of(spark, [(int(i), [float(x) for x in row], 0) for i, row in zip(ids, v)]), F.col("id") % 20 == 0, k=6,
                     factor=1.0, shard_values=300, block_values=100).collect():
        got.setdefault((r["query_id"], r["query_row"]), []).append((r["rank"], r["vec_id"], r["score"]))
    w = v.astype(np.float64)
    expected = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = (w[i][None] * w).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:6]
        expected.append((int(ids[i]), [(n + 1, int(ids[j]), float(score[j])) for n, j in enumerate(order)]))
    assert sorted((q, sorted(x)) for (q, _), x in got.items()) == sorted(expected)
