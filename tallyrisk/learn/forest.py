"""Random forests from histograms that Spark sums, over distinct binned rows.

Features are cut into bins once, and rows that agree in every bin, label and weight become one row with a count. A tree's bootstrap
draws each row by Poisson(1), so of n equal rows it takes Poisson(n): the law of the forest is that of the single rows, while the work
grows with the distinct rows. A pass sums the histograms of the open nodes of all trees, and tasks, not the driver, choose the cuts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import discard, land_at
from tallyrisk.learn.boosting import REDUCERS, UNIT, BoostedTrees, Tree, bin_edges, binned, collapsed, mixed, slices

# Rows of a task that are worked on at once, bytes of the histograms of a pass, distinct rows whose score a task remembers.
SLICE_ROWS, PASS_BYTES, KNOWN_ROWS = 1 << 15, 64 << 20, 1 << 20
_ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # Poisson(1)
_SHARES = {"all": lambda n: n, "sqrt": lambda n: math.ceil(math.sqrt(n)), "log2": lambda n: max(1, math.ceil(math.log2(n))),
           "onethird": lambda n: math.ceil(n / 3)}
_SIDES = [f"{side}{i}" for side in ("left", "right") for i in range(3)]


@dataclass(frozen=True)
class Forestry:
    """Settings under MLlib's names."""

    numTrees: int = 20
    maxDepth: int = 5
    minInstancesPerNode: int = 1
    featureSubsetStrategy: str = "sqrt"
    maxBins: int = 32


def draws(key: np.ndarray, count: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees): how often each tree takes each row, Poisson with mean `count`, by the row's key alone."""
    out = np.empty((len(key), trees), np.int64)
    one = count == 1
    for t in range(trees):
        out[one, t] = np.searchsorted(_ONE, mixed(key[one], seed, t), side="right")
    for i in np.flatnonzero(~one):
        out[i] = np.random.default_rng((seed, int(key[i]) & (1 << 64) - 1)).poisson(count[i], trees)
    return out


def leaf_of(tree: Tree, flat: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The node each row ends in; `flat` holds the bins row by row. Rows at a leaf drop out as they reach it."""
    out, at, where, first = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32), np.arange(len(rows)), rows * width
    while len(at):
        feature = tree.feature[at]
        inner = feature >= 0
        if not inner.all():
            out[where[~inner]] = at[~inner]
            at, where, first, feature = at[inner], where[inner], first[inner], feature[inner]
        at = np.where(flat[first + feature] <= tree.bin[at], tree.left[at], tree.right[at])
    return out


def _histograms(open_: list[tuple], width: int, bins: int, n_trees: int, seed: int, chosen: int):
    """Arrow batches of binned rows to (node, slot, drawn rows, weight of class 0, of class 1) of the open nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_ROWS):
            flat = np.column_stack([part[f"b{i}"] for i in range(width)]).ravel()
            label, weight = part["label"], np.rint(part["weight"] * UNIT)
            taken = draws(part["key"], part["n"], n_trees, seed)
            for t, tree, place, features, first in open_:
                rows = np.flatnonzero(taken[:, t])
                node = place[leaf_of(tree, flat, rows, width)]
                rows, node = rows[node >= 0], node[node >= 0]
                times = taken[rows, t].astype(float)
                heavy, cell = times * weight[rows], len(features) * chosen * bins
                sums = np.zeros((3, cell))
                for k in range(chosen):
                    slot = (node * chosen + k) * bins + flat[rows * width + features[node, k]]
                    sums[0] += np.bincount(slot, times, cell)
                    sums[1] += np.bincount(slot, heavy * (label[rows] != 1), cell)
                    sums[2] += np.bincount(slot, heavy * (label[rows] == 1), cell)
                slot = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + slot // (chosen * bins)), pa.array(slot % (chosen * bins)), *(pa.array(s[slot]) for s in sums)],
                    names=["node", "slot", "c", "w0", "w1"])

    return work


def impurity(side: np.ndarray) -> np.ndarray:
    """Gini impurity times weight of (.., 3) sums."""
    total = np.maximum(side[..., 1] + side[..., 2], 1e-300)
    return 2 * side[..., 1] * side[..., 2] / total


def best_cuts(histograms: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """(gain, place of the feature, bin, left, right) of the best cut of each (features, bins, 3) histogram; gain 0 where none fits."""
    left = histograms.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    fits = (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows)
    gain = np.where(fits, impurity(total) - impurity(left) - impurity(right), 0.0)
    gain[gain <= 1e-12 * np.maximum(impurity(total), 1e-300)] = 0.0
    best = gain.reshape(len(gain), gain.shape[1] * gain.shape[2]).argmax(axis=1)
    k, b = np.divmod(best, gain.shape[2])
    at = np.arange(len(gain)), k, b
    return gain[at], k, b, left[at], right[at]


def _cuts(nodes: int, chosen: int, bins: int, min_rows: int):
    """Sums the histograms of a reducer's nodes and cuts each at its best."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((nodes * chosen * bins, 3)), np.zeros(nodes, bool)
        for batch in batches:
            node, slot, *sums = (c.to_numpy() for c in batch.columns)
            seen[node] = True
            for i, s in enumerate(sums):
                np.add.at(total[:, i], node * chosen * bins + slot, s)
        told = np.flatnonzero(seen)
        found = total.reshape(nodes, chosen, bins, 3)[told]
        gain, k, b, left, right = best_cuts(found, min_rows)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(gain), pa.array(k), pa.array(b), *(pa.array(s[:, i].copy()) for s in (left, right) for i in range(3)),
                                          *(pa.array(found[:, 0, :, i].sum(axis=1)) for i in range(3))],
                                         names=["node", "gain", "k", "bin", *_SIDES, "all0", "all1", "all2"])

    return work


class _Growing:
    """One tree while it grows: node lists, and the nodes that may still be cut."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.sums, self.open = [-1], [0], [-1], [-1], [np.zeros(3)], [0]

    def add(self, sums: np.ndarray) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.sums, sums)):
            column.append(value)
        return len(self.sums) - 1

    def tree(self, share: float = 1.0) -> Tree:
        sums = np.array(self.sums)
        weight = sums[:, 1] + sums[:, 2]
        return Tree(np.array(self.feature, np.int32), np.array(self.bin, np.int16), np.array(self.left, np.int32), np.array(self.right, np.int32),
                    share * sums[:, 2] / np.where(weight > 0, weight, 1.0), weight / UNIT)


def random_forest(rows: DataFrame, features: Sequence[str], settings: Forestry, label: str = "label", size: int = 0,
                  weight: str = "weight", seed: int = 0) -> ForestTrees:
    """Fit on all rows, all trees a level at once; a level is one job, or several where its histograms exceed PASS_BYTES."""
    spark, n = rows.sparkSession, len(features)
    chosen, bins = min(n, _SHARES[settings.featureSubsetStrategy](n)), settings.maxBins
    edges = bin_edges(rows, features, bins)
    path, table = land_at(collapsed(rows, features, edges, label, weight, size), "forest")
    most = max(1, PASS_BYTES // (chosen * bins * 3 * 8))
    growing = [_Growing() for _ in range(settings.numTrees)]
    for depth in range(settings.maxDepth):
        asked = [(t, part) for t, g in enumerate(growing) for part in _parts(g.open, most)]
        for g in growing:
            g.open = []
        rngs = [np.random.default_rng((seed, t, depth)) for t in range(settings.numTrees)]
        while asked:
            nodes, ask = [], []
            while asked and len(nodes) + len(asked[0][1]) <= most:
                t, part = asked.pop(0)
                tree = growing[t].tree()
                place = np.full(len(tree.feature), -1, np.int64)
                place[part] = np.arange(len(part))
                picked = np.sort(rngs[t].random((len(part), n)).argsort(axis=1)[:, :chosen], axis=1)
                ask.append((t, tree, place, picked, len(nodes)))
                nodes += [(t, at, f) for at, f in zip(part, picked.tolist())]
            sums = table.mapInArrow(_shipped(_histograms(ask, n, bins, settings.numTrees, seed, chosen)), "node long, slot long, c double, w0 double, w1 double")
            found = sums.repartition(REDUCERS, "node").mapInArrow(
                _shipped(_cuts(len(nodes), chosen, bins, settings.minInstancesPerNode)),
                ", ".join(["node long, gain double, k long, bin long", *(f"{c} double" for c in (*_SIDES, "all0", "all1", "all2"))])).toPandas()  # a row a node
            _grown(growing, nodes, found, settings, last=depth == settings.maxDepth - 1)
    discard(spark, path)
    return ForestTrees(list(features), edges, 0.0, [g.tree(1 / len(growing)) for g in growing])


def _parts(nodes: list[int], most: int) -> list[list[int]]:
    return [nodes[i:i + most] for i in range(0, len(nodes), most)]


def _grown(growing: list[_Growing], nodes: list[tuple], found: pd.DataFrame, settings: Forestry, last: bool) -> None:
    sides = found[_SIDES].to_numpy(), found[["all0", "all1", "all2"]].to_numpy()
    for i, (place, gain, k, b) in enumerate(zip(*(found[c].tolist() for c in ("node", "gain", "k", "bin")))):
        t, at, features = nodes[place]
        g = growing[t]
        g.sums[at] = sides[1][i]
        if gain <= 0:
            continue
        left, right = g.add(sides[0][i, :3]), g.add(sides[0][i, 3:])
        g.feature[at], g.bin[at], g.left[at], g.right[at] = features[k], b, left, right
        if not last:
            g.open += [c for c in (left, right) if g.sums[c][0] >= 2 * settings.minInstancesPerNode and g.sums[c][1] > 0 and g.sums[c][2] > 0]


class ForestTrees(BoostedTrees):
    """A fitted forest on raw feature values: the values a row meets add up to its probability."""

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """Probability of rows of bins."""
        flat, rows, out = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)), np.zeros(len(bins))
        for tree in self.trees:
            out += tree.value[leaf_of(tree, flat, rows, bins.shape[1])]
        return out

    def margins(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return self.sums(np.column_stack([binned(np.asarray(v, float), e) for v, e in zip(values, self.edges)]))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """`df` with the probability of the positive class; a NULL or NaN feature counts as larger than all values."""
        model = df.sparkSession.sparkContext.broadcast(_pickled(self))

        @F.pandas_udf("double")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            known = Known(pickle.loads(model.value))
            for columns in batches:
                yield pd.Series(known.scores([c.to_numpy(float) for c in columns]))

        return df.withColumn(name, _called(probability, [F.col(c).cast("double") for c in self.features]))


class Known:
    """Scores of the binned rows a task has met; equal rows are walked through the trees once."""

    def __init__(self, model: ForestTrees):
        self.model, self.dims = model, [len(e) + 1 for e in model.edges]
        self.codes, self.told = np.empty(0, np.int64), np.empty(0)

    def scores(self, values: Sequence[np.ndarray]) -> np.ndarray:
        bins = np.column_stack([binned(v, e) for v, e in zip(values, self.model.edges)])
        if math.prod(self.dims) >= 1 << 62:
            return self.model.sums(bins)
        codes, first, back = np.unique(np.ravel_multi_index(tuple(bins.T.astype(np.int64)), self.dims), return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, codes)
        new = np.ones(len(codes), bool) if not len(self.codes) else self.codes[np.minimum(at, len(self.codes) - 1)] != codes
        if len(self.codes) + new.sum() > KNOWN_ROWS:
            self.codes, self.told, at, new = np.empty(0, np.int64), np.empty(0), np.zeros(len(codes), int), np.ones(len(codes), bool)
        self.told = np.insert(self.told, at[new], self.model.sums(bins[first[new]]))
        self.codes = np.insert(self.codes, at[new], codes[new])
        return self.told[np.searchsorted(self.codes, codes)][back]


def _called(function, columns: list[Column]) -> Column:
    _shipped(None)
    return function(*columns)


def _shipped(function):
    """A task function by value, so that workers need not have the package."""
    import tallyrisk.learn.boosting as base
    import tallyrisk.learn.forest as here

    cloudpickle.register_pickle_by_value(base)
    cloudpickle.register_pickle_by_value(here)
    return function


def _pickled(value) -> bytes:
    _shipped(None)
    return cloudpickle.dumps(value)
