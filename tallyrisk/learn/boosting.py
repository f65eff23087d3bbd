"""Gradient boosting from histograms that Spark sums.

Features are cut into at most MOST_BINS bins once, and rows that agree in every bin, label and weight become one row with a count: their
gradients are equal, and of n rows a round draws a binomial number. What is read a pass grows with the distinct rows, which tasks hold
as arrays. A pass adds, inside each task, the gradients of the rows of every asked node into a histogram, and the tasks' are added up;
the driver sees histograms, never rows. Of two siblings the smaller is counted, the other is the parent's less it.

Trees grow the leaf of largest gain first. A leaf's gain does not depend on the order of splits, so a pass asks for the children of
all leaves that could be chosen with what is known, and a tree takes about as many passes as it is deep, not as many as it has leaves.

A round begins with the margins, gradients and drawn rows that follow from the tree before, kept by the executors for the round's
passes. Rounds come in blocks, whose end writes the margins anew and measures every round on validation. A lost executor costs the
rounds of a block; more rounds go on from the last margins. Gradients are summed as whole multiples of 1/UNIT, so a fit does not depend
on how rows are partitioned.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.landing import discard, fresh_path, land_at
from tallyrisk.operators.curve import curve_of_counts, pr_auc

MOST_BINS, UNIT, BLOCK_ROUNDS, PATIENCE = 255, 1 << 24, 20, 50
# Rows of a task that are worked on at once, and accuracy of the bins' quantiles.
SLICE_ROWS, QUANTILE_ACCURACY = 1 << 16, 10_000
# Equal rows up to which each is drawn by a hash of its own; beyond, a hash of their key draws them together.
MOST_COPIES = 16
# Rows of the table that make a file of the distinct rows, beyond one a core.
FILE_ROWS = 1 << 21
# Distinct rows of a boosting task: at least, as far as there are enough for every core, and at most.
LEAST_ROWS, MOST_ROWS = 1 << 15, 1 << 20
# Tasks of a forest that sum the histograms of a pass, and tasks of boosting whose histograms the driver adds up by itself.
REDUCERS, DIRECT = 8, 32


@dataclass(frozen=True)
class Growth:
    """How trees grow: limits on leaves and depth (None: without), the least rows and curvature of a leaf, shrinkage and shares."""

    leaves: int | None = None
    depth: int | None = None
    min_rows: int = 1
    min_curvature: float = 1e-3
    l2: float = 0.0
    step: float = 0.05
    row_share: float = 1.0
    feature_share: float = 1.0


@dataclass
class Tree:
    """Nodes from the root on; feature is -1 at leaves, a row goes left where its bin is at most `bin`."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


def rows_by_node(tree: Tree, columns: Sequence[np.ndarray], rows: np.ndarray, wanted: Sequence[int] | None = None) -> dict[int, np.ndarray]:
    """The rows of every leaf of a tree that any row reaches; of the wanted leaves alone, if they are given."""
    ahead = np.ones(len(tree.feature), bool) if wanted is None else _above(tree, wanted)
    found, open_ = {}, [(0, rows)]
    while open_:
        node, mine = open_.pop()
        if not len(mine) or not ahead[node]:
            continue
        f = tree.feature[node]
        if f < 0:
            found[node] = mine
        else:
            goes = columns[f][mine] <= tree.bin[node]
            open_ += [(int(side), mine[sent]) for side, sent in ((tree.left[node], goes), (tree.right[node], ~goes)) if ahead[side]]
    return found


def _above(tree: Tree, wanted: Sequence[int]) -> np.ndarray:
    """Which nodes are wanted or lead to a wanted one; children are numbered after their parent."""
    out = np.zeros(len(tree.feature), bool)
    out[list(wanted)] = True
    for node in range(len(out) - 1, -1, -1):
        if tree.feature[node] >= 0:
            out[node] |= out[tree.left[node]] | out[tree.right[node]]
    return out


def add_tree(tree: Tree, columns: Sequence[np.ndarray], margin: np.ndarray) -> None:
    for node, rows in rows_by_node(tree, columns, np.arange(len(margin))).items():
        margin[rows] += tree.value[node]


def mixed(key: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A value in [0, 1) of each key and the turn."""
    with np.errstate(over="ignore"):
        h = (key.view(np.uint64) ^ np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def drawn(key: np.ndarray, count: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """How many of its `count` equal rows a round takes of each: each by itself with probability `share`, by the key and the round."""
    if share >= 1:
        return count
    out, copy, rows = np.zeros(len(key), np.int64), 0, np.flatnonzero(count <= MOST_COPIES)
    while len(rows):  # a hash for every copy
        out[rows] += mixed(key[rows] ^ np.int64(copy * 0x2545F4914F6CDD1D % (1 << 63)), seed, turn) < share
        copy += 1
        rows = rows[count[rows] > copy]
    many = np.flatnonzero(count > MOST_COPIES)
    many = many[count[many].argsort(kind="stable")]
    for rows in np.split(many, np.flatnonzero(np.diff(count[many])) + 1) if len(many) else ():  # those of one count
        first, steps = _binomial(int(count[rows[0]]), share)
        out[rows] = first + np.minimum(steps.searchsorted(mixed(key[rows], seed, turn), side="right"), len(steps) - 1)
    return out


def _binomial(n: int, share: float) -> tuple[int, np.ndarray]:
    """The least number of n that is drawn, and the chances to draw up to it and each larger one; what is nine deviations off is left out."""
    spread = 9 * (n * share * (1 - share)) ** 0.5 + 9
    first, last = max(0, int(n * share - spread)), min(n, int(n * share + spread) + 1)
    k = np.arange(first, last)
    log = np.concatenate([[0.0], np.log((n - k) / (k + 1) * (share / (1 - share))).cumsum()])
    chances = np.exp(log - log.max()).cumsum()
    return first, chances / chances[-1]


def chance(margin: np.ndarray) -> np.ndarray:
    """Probability of a margin; beyond 40 either way it no longer changes."""
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log loss in whole multiples of 1 / UNIT, as doubles."""
    p = chance(margin)
    return np.rint(weight * (p - label) * UNIT), np.rint(weight * p * (1 - p) * UNIT)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """Columns of up to `most` rows and one batch."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield _columns(held)
            held, rows = [], 0
    if rows:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {name: table.column(name).to_numpy() for name in table.column_names}


def _shipped(function: Callable) -> Callable:
    """A task function by value, so that workers need not have the package."""
    import tallyrisk.learn.boosting as here

    cloudpickle.register_pickle_by_value(here)
    return function


# -- binning

def bin_edges(df: DataFrame, features: Sequence[str], bins: int = MOST_BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last of each feature: its quantiles, in one pass. NULL and NaN are not counted."""
    shares = [i / bins for i in range(1, bins)]
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    found = df.agg(*[F.percentile_approx(c, shares, QUANTILE_ACCURACY).alias(f"q{i}") for i, c in enumerate(clean)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(len(features))]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place of each value among the edges, 0 for those up to the first; NaN is beyond all."""
    return np.searchsorted(edges, values, side="left").astype(np.int16)


def collapsed(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], label: str, weight: str | None, rows: int = 0) -> DataFrame:
    """`distinct_rows`, dealt over all cores, as many passes read them; `rows` is the size of `df`."""
    return distinct_rows(df, features, edges, label, weight).repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS))


def distinct_rows(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], label: str, weight: str | None) -> DataFrame:
    """b0.. (bins), label, weight, n (rows that agree in all of these) and key (a hash of them); a NULL feature counts as NaN.

    Equal rows are added up inside the tasks first.
    """
    n = len(features)
    plain = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)],
                      F.col(label).cast("double").alias("label"),
                      (F.col(weight).cast("double") if weight is not None and weight in df.columns else F.lit(1.0)).alias("weight"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pa.array(binned(batch.column(i).to_numpy(zero_copy_only=False), edges[i])) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*out, batch.column(n), batch.column(n + 1)], names=_names(n)[:-3])

    kinds = [*(f"b{i}" for i in range(n)), "label", "weight"]
    counted = plain.mapInArrow(_shipped(work), ", ".join(_schema(n).split(", ")[:-3])).groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("key", F.xxhash64(*kinds))


def packed(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], label: str, weight: str | None, margin: float,
           rows: int = 0) -> DataFrame:
    """The distinct binned rows with the margin that all start from."""
    return collapsed(df, features, edges, label, weight, rows).withColumn("margin", F.lit(margin))


def _names(n: int) -> list[str]:
    return [*(f"b{i}" for i in range(n)), "label", "weight", "n", "key", "margin"]


def _schema(n: int) -> str:
    return ", ".join([*(f"b{i} short" for i in range(n)), "label double", "weight double", "n long", "key long", "margin double"])


# -- one tree

def add_histograms(total: np.ndarray, place: dict[int, int], tree: Tree, part: dict[str, np.ndarray]) -> None:
    """Add the gradients of the drawn rows to the histograms (node, feature, bin, 3) of the nodes that have a place."""
    columns = [part[f"b{i}"] for i in range(total.shape[1])]
    for node, rows in rows_by_node(tree, columns, np.flatnonzero(part["taken"]), list(place)).items():
        slope, curve, taken = part["slope"][rows], part["curve"][rows], part["taken"][rows]
        for f, column in enumerate(columns):
            b, into = column[rows], total[place[node], f]
            for i, values in enumerate((slope, curve, taken)):
                into[:, i] += np.bincount(b, values, MOST_BINS).astype(np.int64)


class Histograms:
    """Histograms of nodes of the tree that grows, summed over the rows of a round by one job an ask."""

    def __init__(self, rows: RDD, n_features: int):
        self.rows, self.n = rows, n_features

    def ask(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        """(nodes, features, bins, 3): slope, curvature and rows of each, as whole numbers in doubles below 2^53 or close to them."""
        shape, direct = (len(nodes), self.n, MOST_BINS, 3), self.rows.getNumPartitions() <= DIRECT
        place = {node: i for i, node in enumerate(nodes)}

        def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator:
            total = np.zeros(shape, np.int64)
            for part in parts:
                add_histograms(total, place, tree, part)
            if direct:
                flat = total.reshape(-1, 3)
                slot = np.flatnonzero(flat[:, 2])
                yield slot.astype(np.int32), flat[slot]
            else:
                yield total

        found = self.rows.mapPartitions(_shipped(work))
        if direct:
            total = np.zeros((len(nodes) * self.n * MOST_BINS, 3), np.int64)
            for slot, sums in found.collect():  # at most nodes x features x bins rows a task
                total[slot] += sums
        else:
            total = found.treeReduce(np.add)
        return total.reshape(shape) / np.array([UNIT, UNIT, 1.0])


@dataclass
class _Node:
    total: np.ndarray
    depth: int
    histogram: np.ndarray | None = None
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    children: tuple[int, int] | None = None
    sides: tuple = field(default_factory=tuple)


def best_split(histogram: np.ndarray, allowed: np.ndarray, growth: Growth) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """(gain, feature, bin, left, right) of the best cut; the first of equal ones, gain 0 where none is allowed."""
    left = histogram.cumsum(axis=1)
    total = left[:, -1:]
    right = total - left

    def strength(side: np.ndarray) -> np.ndarray:
        return side[..., 0] ** 2 / np.maximum(side[..., 1] + growth.l2, 1e-12)

    fits = allowed[:, None]
    for side in (left, right):
        fits = fits & (side[..., 2] >= growth.min_rows) & (side[..., 1] >= growth.min_curvature)
    gain = np.where(fits, strength(left) + strength(right) - strength(total), 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def grow_tree(histograms: Histograms, allowed: np.ndarray, growth: Growth) -> Tree:
    """One tree, the leaf of largest gain first (of equal ones the older)."""
    nodes = [_Node(np.zeros(3), 0)]
    most = growth.leaves or 1 << 30

    def learn(node: _Node, histogram: np.ndarray) -> None:
        node.histogram, node.total = histogram, histogram[0].sum(axis=0)
        node.gain, node.feature, node.bin, *node.sides = best_split(histogram, allowed, growth)

    def may_split(node: _Node) -> bool:
        return (growth.depth is None or node.depth < growth.depth) and node.total[2] >= 2 * growth.min_rows and node.total[1] >= 2 * growth.min_curvature

    def chosen() -> list[int]:
        """The splits in the order in which they are made, with what is known; unknown children are not waited for."""
        heap, picks = [(-nodes[0].gain, 0)], []
        while heap and len(picks) < most - 1:
            gain, at = heapq.heappop(heap)
            if gain >= 0:
                break
            picks.append(at)
            for child in nodes[at].children or ():
                if nodes[child].histogram is not None:
                    heapq.heappush(heap, (-nodes[child].gain, child))
        return picks

    learn(nodes[0], histograms.ask(_frozen(nodes, [], growth), [0])[0])
    while True:
        picks = chosen()
        for at in picks:
            node = nodes[at]
            if node.children is None:
                node.children = len(nodes), len(nodes) + 1
                nodes += [_Node(side, node.depth + 1) for side in node.sides]
        # The last pick's children come too late to be split.
        waiting = [at for at in (picks if len(picks) < most - 1 else picks[:-1])
                   if any(nodes[c].histogram is None and may_split(nodes[c]) for c in nodes[at].children)]
        if not waiting:
            return _frozen(nodes, picks, growth)
        smaller = [min(nodes[at].children, key=lambda c: nodes[c].total[2]) for at in waiting]
        split = [at for at, node in enumerate(nodes) if node.children is not None]
        route, number = _frozen(nodes, split, growth, numbers=True)
        for at, small, found in zip(waiting, smaller, histograms.ask(route, [number[c] for c in smaller])):
            for child in nodes[at].children:
                if may_split(nodes[child]):
                    learn(nodes[child], found if child == small else nodes[at].histogram - found)
                else:
                    nodes[child].histogram = found  # never split: gain stays 0


def _frozen(nodes: list[_Node], split: list[int], growth: Growth, numbers: bool = False):
    """The tree of the given splits, nodes numbered from the root in order of depth first seen."""
    inner, order = set(split), [0]
    for at in order:
        if at in inner:
            order += nodes[at].children
    number = {at: i for i, at in enumerate(order)}
    of = [nodes[at] for at in order]
    leaf = [at not in inner for at in order]
    tree = Tree(np.array([-1 if is_leaf else n.feature for n, is_leaf in zip(of, leaf)], np.int32),
                np.array([n.bin for n in of], np.int16),
                np.array([-1 if is_leaf else number[n.children[0]] for n, is_leaf in zip(of, leaf)], np.int32),
                np.array([-1 if is_leaf else number[n.children[1]] for n, is_leaf in zip(of, leaf)], np.int32),
                np.array([-growth.step * n.total[0] / max(n.total[1] + growth.l2, 1e-12) for n in of]),
                np.array([n.total[2] for n in of]))
    return (tree, number) if numbers else tree


# -- rounds

def _parts(table: DataFrame, n: int) -> RDD:
    """The rows of a written table as arrays of up to SLICE_ROWS and an Arrow batch, dealt over as many tasks as they are worth."""
    count, cores = table.count(), table.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-count // LEAST_ROWS)), -(-count // MOST_ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = {c: v.astype(np.uint8) if c.startswith("b") else v for c, v in part.items()}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part, 5)], pa.binary())], names=["part"])

    return table.select(*_names(n)).repartition(tasks).mapInArrow(_shipped(work), "part binary").rdd.map(lambda row: pickle.loads(row[0]))


def _kept(rows: RDD, path: str) -> RDD:
    """The parts as written at `path`."""
    rows.saveAsPickleFile(path, 1)
    return rows.ctx.pickleFile(path)


def _begun(tree: Tree | None, n: int, seed: int, turn: int, share: float) -> Callable:
    """Parts with the margins after the tree before, and what a round draws of the rows: slope and curve of as many as are taken."""

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        for part in parts:
            part = _added(part, tree, n)
            slope, curve = gradients(part["margin"], part["label"], part["weight"])
            taken = drawn(part["key"], part["n"], seed, turn, share)
            yield {**part, "slope": slope * taken, "curve": curve * taken, "taken": taken}

    return _shipped(work)


def _ended(tree: Tree, n: int) -> Callable:
    """Parts as they were written, with the margins after the last tree."""

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        for part in parts:
            yield {c: v for c, v in _added(part, tree, n).items() if c in _names(n)}

    return _shipped(work)


def _added(part: dict[str, np.ndarray], tree: Tree | None, n: int) -> dict[str, np.ndarray]:
    margin = part["margin"].copy()
    if tree is not None:
        add_tree(tree, [part[f"b{i}"] for i in range(n)], margin)
    return {**part, "margin": margin}


class Binned:
    """What a fit starts from, written once for all fits on the same rows: edges, distinct binned rows and their log-odds."""

    def __init__(self, train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = "weight"):
        self.spark, self.features = train.sparkSession, list(features)
        self.edges = bin_edges(train, features)
        w = F.col(weight).cast("double") if weight is not None and weight in train.columns else F.lit(1.0)
        row = train.agg((F.sum(w * F.col(label)) / F.sum(w)).alias("p"), F.count(F.lit(1)).alias("rows")).first()
        share = min(max(row["p"] or 0.0, 1e-9), 1 - 1e-9)
        self.base = float(np.log(share / (1 - share)))
        path, told = land_at(distinct_rows(train, features, self.edges, label, weight), "boost-rows")
        self.paths = [fresh_path(self.spark, "boost-train")]
        self.train = _kept(_parts(told.withColumn("margin", F.lit(self.base)), len(features)), self.paths[0])
        discard(self.spark, path)
        path, self.val = land_at(packed(val, features, self.edges, label, None, self.base, row["rows"]), "boost-val")
        self.paths.append(path)

    def close(self) -> None:
        """The written tables go."""
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


class Boosting:
    """A fit that can go on: its trees, their validation measures, and the written tables that carry every row's margin."""

    def __init__(self, train: DataFrame, val: DataFrame, features: Sequence[str], growth: Growth, label: str = "label",
                 weight: str | None = "weight", seed: int = 0, start: Binned | None = None):
        self.spark, self.features, self.growth, self.seed = train.sparkSession, list(features), growth, seed
        given, start = start, start or Binned(train, val, features, label, weight)
        self.edges, self.base, self._train, self._val = start.edges, start.base, start.train, start.val
        self.trees: list[Tree] = []
        self.measures: list[float] = []
        self._paths: list[str] = [] if given else start.paths

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path, out = land_at(df, name)
        self._paths.append(path)
        return out

    @property
    def best_rounds(self) -> int:
        """Rounds with the best validation PR-AUC, the first of equal ones."""
        return int(np.argmax(self.measures)) + 1 if self.measures else 0

    def run(self, rounds: int, patience: int | None = PATIENCE, block: int = BLOCK_ROUNDS) -> Boosting:
        """Up to `rounds` rounds more; ends early where the best is `patience` rounds back at the end of a block."""
        n, end = len(self.features), len(self.trees) + rounds
        while len(self.trees) < end and not (patience is not None and len(self.trees) - self.best_rounds >= patience):
            turns = range(len(self.trees), min(len(self.trees) + block, end))
            fresh: list[Tree] = []
            rows = self._train
            for turn in turns:
                before, rows = rows, rows.mapPartitions(_begun(fresh[-1] if fresh else None, n, self.seed, turn, self.growth.row_share))
                rows.persist(StorageLevel.MEMORY_AND_DISK)
                fresh.append(grow_tree(Histograms(rows, n), self._allowed(turn), self.growth))
                before.unpersist()
            self.measures += self._measured(fresh)
            self.trees += fresh
            old, self._paths = self._paths, []
            self._paths.append(fresh_path(self.spark, "boost-train"))
            self._train = _kept(rows.mapPartitions(_ended(fresh[-1], n)), self._paths[-1])
            self._val = self._written(self._carried(self._val, fresh), "boost-val")
            rows.unpersist()
            for path in old:
                discard(self.spark, path)
        return self

    def _allowed(self, turn: int) -> np.ndarray:
        """The features a round may split by."""
        n = len(self.features)
        return np.isin(np.arange(n), np.random.default_rng((self.seed, turn)).permutation(n)[:max(1, round(self.growth.feature_share * n))])

    def _carried(self, table: DataFrame, fresh: list[Tree]) -> DataFrame:
        n = len(self.features)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                margin = part["margin"].copy()
                for tree in fresh:
                    add_tree(tree, [part[f"b{i}"] for i in range(n)], margin)
                yield pa.RecordBatch.from_arrays([pa.array(part[c]) for c in _names(n)[:-1]] + [pa.array(margin)], names=_names(n))

        return table.mapInArrow(_shipped(work), _schema(n))

    def _measured(self, fresh: list[Tree]) -> list[float]:
        """Validation PR-AUC after each of the fresh trees, all from one pass: tasks send counts of distinct margins."""
        n, first = len(self.features), len(self.trees)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                margin, columns = part["margin"].copy(), [part[f"b{i}"] for i in range(n)]
                for i, tree in enumerate(fresh):
                    add_tree(tree, columns, margin)
                    values, place = np.unique(margin, return_inverse=True)
                    pos, rows = (np.bincount(place, c).astype(np.int64) for c in (part["label"] * part["n"], part["n"]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), first + i, np.int32)), pa.array(values), pa.array(pos), pa.array(rows - pos)],
                                                     names=["round", "score", "pos", "neg"])

        counts = self._val.mapInArrow(_shipped(work), "round int, score double, pos long, neg long").groupBy("round", "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        found = {r["round"]: r["pr_auc"] for r in pr_auc(curve_of_counts(counts, ["round"]), ["round"]).collect()}  # one row a round
        # Twelve places, so that the order of sums decides no tie.
        return [round(found.get(first + i) or 0.0, 12) for i in range(len(fresh))]

    def model(self, rounds: int | None = None) -> BoostedTrees:
        """The first `rounds` trees, by default the best on validation."""
        return BoostedTrees(self.features, self.edges, self.base, self.trees[:self.best_rounds if rounds is None else rounds])

    def close(self) -> BoostedTrees:
        """The best model; the written tables go."""
        for path in self._paths:
            discard(self.spark, path)
        self._paths = []
        return self.model()


@dataclass
class BoostedTrees:
    """A fitted ensemble on raw feature values."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def margins(self, values: Sequence[np.ndarray]) -> np.ndarray:
        columns = [binned(np.asarray(v, float), e) for v, e in zip(values, self.edges)]
        margin = np.full(len(columns[0]), self.base)
        for tree in self.trees:
            add_tree(tree, columns, margin)
        return margin

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """`df` with the probability of the positive class; a NULL or NaN feature counts as larger than all values."""
        model = df.sparkSession.sparkContext.broadcast(_pickled(self))

        @F.pandas_udf("double")
        def probability(*columns):
            import pandas as pd

            if not hasattr(model, "opened"):
                model.opened = pickle.loads(model.value)
            return pd.Series(chance(model.opened.margins([c.to_numpy(float) for c in columns])))

        return df.withColumn(name, _by_value(probability)(*[F.col(c).cast("double") for c in self.features]))


    def save(self, spark: SparkSession, path: str) -> None:
        """Replace what is at `path` by two Parquet tables: `nodes` of all trees and `bins` of the features."""
        nodes = [(i, at, int(t.feature[at]), int(t.bin[at]), int(t.left[at]), int(t.right[at]), float(t.value[at]), float(t.cover[at]))
                 for i, t in enumerate(self.trees) for at in range(len(t.feature))]
        bins = [(i, name, self.base, e.tolist()) for i, (name, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(bins, _BINS).coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        bins = spark.read.schema(_BINS).parquet(f"{path}/bins").orderBy("place").collect()
        nodes = spark.read.schema(_NODES).parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = [Tree(*(part[c].to_numpy() for c in ("feature", "bin", "left", "right", "value", "cover"))) for _, part in nodes.groupby("tree")]
        return cls([b["feature"] for b in bins], [np.array(b["edges"], float) for b in bins], bins[0]["base"], trees)


_NODES = "tree int, node int, feature int, bin int, left int, right int, value double, cover double"
_BINS = "place int, feature string, base double, edges array<double>"


def _pickled(value) -> bytes:
    _shipped(None)
    return cloudpickle.dumps(value)


def _by_value(function):
    _shipped(None)
    return function
