"""Exact Shapley values of tree ensembles, a row at a time and without walks.

A tree is taken apart into its leaves. The path to a leaf asks something of a few features: an interval of values each, and the
share of training rows that would meet it by the covers along the path. With the features of a set S known, a leaf counts with

    value * product over S of (1 if the row's value lies in the interval, else 0) * product over the others of their shares,

and the Shapley value of feature i is an average of (with i) - (without i) over all sets. The weight of a set of size s out of d
features, s! (d - 1 - s)! / d!, is the integral of u^s (1 - u)^(d - 1 - s) over 0..1, so the average over sets is the integral of

    (inside_i - share_i) * product over the other j of (share_j (1 - u) + inside_j u),

a polynomial of degree d - 1 in u, for which Gauss-Legendre quadrature with ceil(d / 2) points is exact. A leaf that asks less than
the widest one is filled up with features that are always inside and have share one; they change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.landing import discard, fresh_path
from tallyrisk.learn.boosting import BoostedTrees

# Cells (rows x leaves x features of a leaf) worked on at once, and leaves of a block.
CELLS, BLOCK_LEAVES = 1 << 20, 4096


@dataclass
class Node:
    """A node of one tree: at a leaf `feature` is -1; else values up to `threshold` go left. `cover` is the training weight."""

    feature: int
    threshold: float
    left: int
    right: int
    value: float
    cover: float


@dataclass
class Leaves:
    """All leaves of an ensemble: what each asks of its features (leaf x slot) and what it adds."""

    width: int
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    start: float = 0.0

    @property
    def base(self) -> float:
        """What the ensemble gives when no feature is known."""
        return self.start + float((self.value * self.share.prod(1)).sum())

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) contributions; NaN lies above every threshold."""
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), self.width))
        slots = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss(max(1, (slots + 1) // 2))
        points, weights = (points + 1) / 2, weights / 2
        for a in range(0, len(self.value), BLOCK_LEAVES):
            block = slice(a, a + BLOCK_LEAVES)
            feature, share = self.feature[block], self.share[block]
            to_feature = np.zeros((feature.size, self.width))
            to_feature[np.arange(feature.size), feature.ravel()] = 1.0
            step = max(1, CELLS // feature.size)
            for r in range(0, len(x), step):
                asked = x[r:r + step][:, feature]
                inside = ((asked > self.low[block]) & (asked <= self.high[block])).astype(float)
                total = np.zeros_like(inside)
                for u, w in zip(points, weights):
                    factor = share * (1 - u) + inside * u
                    total += w * factor.prod(2, keepdims=True) / factor
                total *= (inside - share) * self.value[block][:, None]
                out[r:r + step] += total.reshape(len(asked), -1) @ to_feature
        return out


def leaves_of(trees: Sequence[Sequence[Node]], width: int, start: float = 0.0) -> Leaves:
    """The leaves of all trees over `width` features. A leaf that no training row reached never counts and is left out."""
    found = []
    for nodes in trees:
        open_ = [(0, {})]
        while open_:
            at, asked = open_.pop()
            node = nodes[at]
            if node.feature < 0:
                found.append((asked, node.value))
                continue
            low, high, share = asked.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node.left, (low, min(high, node.threshold))), (node.right, (max(low, node.threshold), high))):
                part = nodes[child].cover / node.cover if node.cover > 0 else 0.0
                if part > 0:
                    open_.append((child, {**asked, node.feature: (*bounds, share * part)}))
    slots = max((len(asked) for asked, _ in found), default=0) or 1
    shape = (len(found), slots)
    out = Leaves(width, np.zeros(shape, int), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in found], float), start)
    for i, (asked, _) in enumerate(found):
        for j, (feature, (low, high, share)) in enumerate(sorted(asked.items())):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = feature, low, high, share
    return out


def boosted_leaves(model: BoostedTrees) -> Leaves:
    """Leaves whose values add up to the margin."""
    def end(feature: int, at: int) -> float:
        edges = model.edges[feature]
        return float(edges[at]) if at < len(edges) else np.inf

    trees = [[Node(int(f), end(int(f), int(b)) if f >= 0 else 0.0, int(left), int(right), float(v), float(c))
              for f, b, left, right, v, c in zip(t.feature, t.bin, t.left, t.right, t.value, t.cover)] for t in model.trees]
    return leaves_of(trees, len(model.features), model.base)


def forest_leaves(spark: SparkSession, model, width: int) -> Leaves:
    """Leaves of an MLlib classification forest whose values add up to the probability of class 1.

    The nodes are read from the saved model, the only place that shows them: as many rows as the forest has nodes.
    """
    path = fresh_path(spark, "forest")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), node["split"]["numCategories"].alias("categories"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        F.get(node["impurityStats"], 0).alias("c0"), F.get(node["impurityStats"], 1).alias("c1")).toPandas()
    if ((rows["left"] >= 0) & (rows["categories"] >= 0)).any():
        raise ValueError("only splits at a threshold are explained")
    discard(spark, path)
    trees = []
    for _, part in rows.groupby("treeID"):
        part = part.sort_values("id")  # numbered from the root on
        place = {n: i for i, n in enumerate(part["id"].tolist())}
        trees.append([
            Node(-1, 0.0, -1, -1, c1 / (c0 + c1) if c0 + c1 else 0.0, c0 + c1) if left < 0 else
            Node(int(feature), threshold, place[left], place[right], 0.0, c0 + c1)
            for left, right, feature, threshold, c0, c1 in
            zip(*(part[c].tolist() for c in ("left", "right", "feature", "threshold", "c0", "c1")))])
    out = leaves_of(trees, width)
    out.value /= max(1, len(trees))
    return out


def contributions(df: DataFrame, leaves: Leaves, features: Sequence[str], key: str = "seq") -> DataFrame:
    """(key, contributions array in the order of `features`, base) of every row; NULL counts as NaN.

    The leaves are broadcast: they grow with the model, not with the table. Each task works on its own rows.
    """
    import tallyrisk.learn.shapley as here

    cloudpickle.register_pickle_by_value(here)
    told, base = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(leaves)), leaves.base
    plain = df.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = pickle.loads(told.value)
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(opened.values(x)), pa.list_(pa.float64())),
                                              pa.array(np.full(len(x), base))], names=["key", "contributions", "base"])

    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(work, f"key {kind}, contributions array<double>, base double").withColumnRenamed("key", key)
