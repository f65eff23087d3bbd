"""Detectors that never see a positive: isolation forest and reconstruction error."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Forest and bottleneck sizes.
TREES, SAMPLE_ROWS, BOTTLENECK = 300, 4096, 8
BLOCK_ROWS = 1 << 12  # rows that step down a tree together

_NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree over n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _binomial_steps(trees: int, chance: float) -> list[float]:
    """Cumulative probabilities of 0, 1, ... draws out of `trees`; steps that are 1 to double precision are left out."""
    if chance >= 1:
        return [0.0] * trees
    steps, log_p, total = [], trees * math.log1p(-chance), 0.0
    for k in range(trees):
        total += math.exp(log_p)
        if total >= 1 - 1e-15:
            break
        steps.append(total)
        log_p += math.log((trees - k) / (k + 1)) + math.log(chance) - math.log1p(-chance)
    return steps


def _prime_from(n: int) -> int:
    """The smallest prime that is at least n and 2."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def tree_samples(df: DataFrame, features: Sequence[str], trees: int, rows: int, seed: int, key: str = "seq",
                 total: int | None = None) -> DataFrame:
    """(tree, x) with exactly min(rows, n) rows per tree, drawn by seeded hashes of the key.

    A row's number of draws is taken from one hash against the binomial law. Its trees are then steps of one random stride from a
    random start, modulo a prime: each tree's sample is uniform, and any two trees draw independently. What is hashed and shuffled is
    about trees x rows, and not a hash for every pair of row and tree.
    """
    n = df.count() if total is None else total
    size = min(rows, n)
    places = _prime_from(trees)  # places from `trees` on belong to no tree
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # Six deviations above the wanted size, so that a tree cannot fall short.
    chance = min(1.0, (size + 6.0 * math.sqrt(size) + 6.0) / max(n, 1))
    draws = sum((unit >= F.lit(at)).cast("int") for at in _binomial_steps(places, chance))
    start = F.pmod(F.xxhash64(F.col(key), F.lit("start"), F.lit(seed)), F.lit(places))
    stride = F.pmod(F.xxhash64(F.col(key), F.lit("stride"), F.lit(seed)), F.lit(places - 1)) + 1
    dealt = (df.withColumn("_draws", draws).filter("_draws > 0")
             .select(F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)).alias("_step"), start.alias("_start"), stride.alias("_stride"),
                     F.col(key).alias("_key"), x)
             .select(F.pmod(F.col("_start") + F.col("_step") * F.col("_stride"), F.lit(places)).cast("int").alias("tree"), "_key", "x")
             .filter(F.col("tree") < trees))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("_key", "tree", F.lit(seed)), "_key"))
    return dealt.withColumn("_rank", rank).filter(F.col("_rank") <= size).select("tree", "x")


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> tuple[np.ndarray, ...]:
    """Node arrays (feature, split, left, right, path) of one isolation tree over the rows of x, grown a level at once.

    A node splits a feature drawn among those that vary in it, at a uniform value of their range; each side gets a row. Leaves have
    feature -1 and themselves as children.
    """
    mean_path = np.array([average_path(n) for n in range(len(x) + 1)])
    levels: list[tuple[np.ndarray, ...]] = []
    rows, node, base = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
    for depth in range(depth_limit + 1):
        if not len(rows):
            break
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        counts = np.diff(np.r_[starts, len(rows)])
        low, high = np.minimum.reduceat(x[rows], starts), np.maximum.reduceat(x[rows], starts)
        usable = high > low
        opened = usable.any(axis=1) & (depth < depth_limit)
        me, k = base + np.arange(len(starts)), int(opened.sum())
        feature = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        at = np.arange(len(starts)), feature
        split = np.minimum(low[at] + rng.random(len(starts)) * (high[at] - low[at]), high[at])
        split = np.where(split > low[at], split, high[at])
        left, right = me.copy(), me.copy()
        left[opened] = base + len(starts) + 2 * np.arange(k)
        right[opened] = left[opened] + 1
        levels.append((np.where(opened, feature, -1), np.where(opened, split, 0.0), left, right,
                       np.where(opened, 0.0, depth + mean_path[counts])))
        here = np.repeat(np.arange(len(starts)), counts)
        rows, here = rows[opened[here]], here[opened[here]]
        node = np.where(x[rows, feature[here]] < split[here], left[here], right[here])
        base += len(starts)
    return tuple(np.concatenate(parts) for parts in zip(*levels))


def _grow(seed: int, depth_limit: int):
    """One tree's sample to its node table."""

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        grown = grow_tree(np.stack(sample["x"].to_numpy()), np.random.default_rng([seed, tree]), depth_limit)
        nodes = dict(zip(("feature", "split", "left", "right", "path"), grown))
        return pd.DataFrame({"tree": tree, "node": np.arange(len(grown[0])), **nodes})

    return build


def stepping(trees: Sequence[tuple[np.ndarray, ...]]) -> list[tuple]:
    """(feature, split, left, path, depth) of every tree as `walked` wants it: a right child follows its left one, a leaf leads to itself."""
    out = []
    for feature, split, left, right, path in trees:
        inner, at, depth = feature >= 0, np.zeros(1, np.int64), 0
        if (right[inner] != left[inner] + 1).any():
            raise ValueError("the right child must follow the left one")
        while len(at := at[inner[at]]):
            at, depth = np.concatenate([left[at], right[at]]), depth + 1
        out.append((np.maximum(feature, 0).astype(np.int64), np.where(inner, split, np.inf), left.astype(np.int64), path, depth))
    return out


def walked(steps: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the path of every row, NaN above all splits.

    A block of rows steps down one tree at a time, whose arrays fit a core's cache; buffers are used again.
    """
    total, width = np.zeros(len(x)), x.shape[1]
    flat = np.minimum(np.where(np.isnan(x), np.inf, x), np.finfo(float).max).ravel()
    for first in range(0, len(x), BLOCK_ROWS):
        rows = np.arange(first, min(first + BLOCK_ROWS, len(x))) * width
        sums, at, tested, goes = np.zeros(len(rows)), np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        value, cut = np.empty(len(rows)), np.empty(len(rows))
        for feature, split, left, path, depth in steps:
            at.fill(0)
            for _ in range(depth):
                feature.take(at, out=tested, mode="clip")
                tested += rows
                flat.take(tested, out=value, mode="clip")
                split.take(at, out=cut, mode="clip")
                np.greater_equal(value, cut, out=goes)
                left.take(at, out=tested, mode="clip")
                np.add(tested, goes, out=at)
            sums += path.take(at)
        total[first:first + len(rows)] = sums
    return total


def path_lengths(trees: Sequence[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the path of every row."""
    return walked(stepping(trees), x)


@dataclass
class IsolationForest:
    """A fitted forest: node arrays per tree, bounded by trees x 2 x sample rows."""

    features: list[str]
    sample_rows: int
    trees: list[tuple[np.ndarray, ...]]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add 2^(-mean depth / expected depth): higher is more anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = max(average_path(self.sample_rows), 1e-12)

        @F.pandas_udf("double")
        def isolate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            steps = stepping(shared.value)
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, 1))
                yield pd.Series(np.exp2(-(walked(steps, x) / len(steps)) / norm))

        return df.withColumn(name, isolate(F.array(*[F.col(c).cast("double") for c in self.features])))


def isolation_forest(legit: DataFrame, features: Sequence[str], trees: int = TREES, rows: int = SAMPLE_ROWS, seed: int = 0,
                     key: str = "seq") -> IsolationForest:
    """Grow the trees in parallel, one task group per tree on a sample of fixed size."""
    n = legit.count()
    size = min(rows, n)
    depth_limit = math.ceil(math.log2(max(size, 2)))
    samples = tree_samples(legit, features, trees, rows, seed, key, n)
    nodes = samples.groupBy("tree").applyInPandas(_grow(seed, depth_limit), _NODE_SCHEMA)
    table = nodes.toPandas().sort_values(["tree", "node"])  # at most trees x 2 x rows nodes
    grown = [tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right", "path")) for _, t in table.groupby("tree")]
    return IsolationForest(list(features), size, grown)


@dataclass
class Reconstruction:
    """Standardise, keep `bottleneck` principal directions, measure what is lost."""

    features: list[str]
    model: PipelineModel

    @property
    def _directions(self) -> np.ndarray:
        return self.model.stages[2].pc.toArray()

    def embed(self, df: DataFrame, name: str = "embedding") -> DataFrame:
        """Add the bottleneck vector of each row."""
        return self.model.transform(df).withColumnRenamed("_embedding", name).drop("_raw", "_scaled")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the mean squared reconstruction error per row."""
        directions = self._directions

        @F.pandas_udf("double")
        def error(scaled: pd.Series) -> pd.Series:
            x = np.stack(scaled.to_numpy()) if len(scaled) else np.empty((0, directions.shape[0]))
            gap = x - x @ directions @ directions.T
            return pd.Series((gap * gap).mean(axis=1))

        scaled = self.model.transform(df)
        return scaled.withColumn(name, error(vector_to_array("_scaled"))).drop("_raw", "_scaled", "_embedding")


def recon_error_fit(legit: DataFrame, features: Sequence[str], bottleneck: int = BOTTLENECK) -> Reconstruction:
    """Linear bottleneck fitted on rows without positives; two distributed passes over the table."""
    width = min(bottleneck, len(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
              PCA(k=width, inputCol="_scaled", outputCol="_embedding")]
    return Reconstruction(list(features), Pipeline(stages=stages).fit(legit))
