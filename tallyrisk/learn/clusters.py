"""K-means segments over an embedding and their use as a feature."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import discard, land_at
from tallyrisk.learn.boosting import mixed

CLUSTERS, STARTS = 12, 10  # fixed values
# Limits of a fit (MLlib's defaults), and rows of a task that are worked on at once.
STEPS, TOLERANCE, SEED_ROUNDS, CHUNK = 20, 1e-4, 2, 1 << 12


@dataclass
class Segments:
    """Centers of a fit and the summed squared distance of its rows to them."""

    centers: np.ndarray
    cost: float
    column: str = "embedding"

    def transform(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """Add the place of the nearest center, the first of equal ones."""
        centers, near = self.centers, _nearest

        @F.pandas_udf("int")
        def cluster(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, centers.shape[1]))
            return pd.Series(near(x, centers)[0].astype("int32"))

        return df.withColumn(name, _shipped(cluster)(vector_to_array(self.column)))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of and squared distance to the nearest center of each row, the first of equal ones.

    Center after center with the rows side by side: a product of two narrow matrices takes several times as long.
    """
    columns, scaled = np.ascontiguousarray(x.T), -2 * centers
    gaps = np.empty((len(centers), len(x)))
    gaps[:] = (centers * centers).sum(axis=1)[:, None]
    for j, column in enumerate(columns):
        gaps += np.multiply.outer(scaled[:, j], column)
    near = gaps[0]
    if len(centers) > 127:
        place, near = gaps.argmin(axis=0), gaps.min(axis=0)
    else:
        place, less = np.zeros(len(x), np.int8), np.empty(len(x), bool)
        for i, gap in enumerate(gaps[1:], 1):
            np.less(gap, near, out=less)
            np.maximum(place, less.view(np.int8) * np.int8(i), out=place)
            near = np.minimum(near, gap)
    square = sum((column * column for column in columns), np.zeros(len(x)))
    return place.astype(np.int64), np.maximum(near + square, 0.0)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        x, key = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column(1).to_numpy()
        for first in range(0, len(x), CHUNK):
            yield x[first:first + CHUNK], key[first:first + CHUNK]


def _summed(table: DataFrame, fits: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows and sums of coordinates by center, cost) of every fit, all from one pass."""
    width = fits[0].shape[1]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in fits])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((starts[-1], width + 2))
        for x, _ in _chunks(batches, width):
            columns = np.ascontiguousarray(x.T)
            for centers, start in zip(fits, starts):
                place, gap = _nearest(x, centers)
                mine = total[start:start + len(centers)]
                for i, column in enumerate([None, *columns]):
                    mine[:, i] += np.bincount(place, column, len(centers))
                mine[0, -1] += gap.sum()
        flat = total.ravel()
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], names=["slot", "v"])

    sums = table.mapInArrow(_shipped(work), "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()  # centers x (features + 2)
    total = np.zeros(starts[-1] * (width + 2))
    total[sums["slot"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(-1, width + 2)
    return [(t[:, 0], t[:, 1:-1], float(t[:, -1].sum())) for t in np.split(total, starts[1:-1])]


def _first(table: DataFrame, width: int, starts: int, seed: int) -> list[np.ndarray]:
    """One row a start: that of the smallest hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, list[float]]] = {}
        for x, key in _chunks(batches, width):
            for s in range(starts):
                h = mixed(key, seed + s, 0)
                i = int(h.argmin())
                if s not in best or h[i] < best[s][0]:
                    best[s] = float(h[i]), x[i].tolist()
        yield pa.RecordBatch.from_pylist([{"start": s, "h": h, "x": x} for s, (h, x) in best.items()],
                                         pa.schema([("start", pa.int32()), ("h", pa.float64()), ("x", pa.list_(pa.float64()))]))

    found = table.mapInArrow(_shipped(work), "start int, h double, x array<double>").groupBy("start").agg(F.min_by("x", "h").alias("x")).collect()
    return [np.array([r["x"]]) for r in sorted(found, key=lambda r: r["start"])]


def _joined(table: DataFrame, fits: list[np.ndarray], costs: Sequence[float], k: int, seed: int, turn: int) -> list[np.ndarray]:
    """The candidates of each start and about 2k rows more, each drawn by itself in proportion to its squared distance."""
    width = fits[0].shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, key in _chunks(batches, width):
            for s, (centers, cost) in enumerate(zip(fits, costs)):
                rows = np.flatnonzero(mixed(key, seed + s, turn) * cost < 2 * k * _nearest(x, centers)[1])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), pa.array(key[rows]), pa.array(x[rows].tolist(), pa.list_(pa.float64()))],
                                                     names=["start", "key", "x"])

    found = table.mapInArrow(_shipped(work), "start int, key long, x array<double>").orderBy("start", "key").collect()  # about 2k rows a start
    return [np.array([*c.tolist(), *(r["x"] for r in found if r["start"] == s)]) for s, c in enumerate(fits)]


def _seeded(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over the weighted candidates, then a few steps over them; fewer centers where fewer candidates differ."""
    rng, weight = np.random.default_rng(seed), np.maximum(weight, 1e-9)
    centers = candidates[[rng.choice(len(candidates), p=weight / weight.sum())]]
    while len(centers) < k:
        pull = _nearest(candidates, centers)[1] * weight
        if pull.sum() <= 0:
            break
        centers = np.vstack([centers, candidates[rng.choice(len(candidates), p=pull / pull.sum())]])
    for _ in range(30):
        place = _nearest(candidates, centers)[0]
        held = np.bincount(place, weight, len(centers))
        sums = np.column_stack([np.bincount(place, weight * c, len(centers)) for c in candidates.T])
        centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], centers)
    return centers


def kmeans_segments(embedded: DataFrame, k: int = CLUSTERS, starts: int = STARTS, seed: int = 0,
                    column: str = "embedding") -> Segments:
    """The fit of least within-cluster cost out of several starts, seeded by k-means||.

    The embedding is written once; all starts take each step together, in one pass over all rows. A start ends when no center moves
    by more than TOLERANCE, or after STEPS.
    """
    plain = embedded.select(vector_to_array(column).alias("x"), F.monotonically_increasing_id().alias("key"))
    path, table = land_at(plain, "segments")
    size = table.select(F.size("x").alias("n")).first()
    if size is None:
        raise ValueError("no rows to segment")
    fits = _first(table, size["n"], starts, seed)
    for turn in range(1, SEED_ROUNDS + 1):
        fits = _joined(table, fits, [cost for _, _, cost in _summed(table, fits)], k, seed, turn)
    fits = [_seeded(c, held, k, seed + s) for s, (c, (held, _, _)) in enumerate(zip(fits, _summed(table, fits)))]
    moving = list(range(starts))
    for _ in range(STEPS):
        still = []
        for s, (held, sums, _) in zip(moving, _summed(table, [fits[s] for s in moving])):
            centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], fits[s])
            if ((centers - fits[s]) ** 2).sum(axis=1).max() > TOLERANCE ** 2:
                still.append(s)
            fits[s] = centers
        moving = still
        if not moving:
            break
    costs = [cost for _, _, cost in _summed(table, fits)]
    discard(embedded.sparkSession, path)
    best = int(np.argmin(costs))
    return Segments(fits[best], costs[best], column)


def _shipped(function):
    """A task function by value, so that workers need not have the package."""
    import tallyrisk.learn.boosting as base
    import tallyrisk.learn.clusters as here

    cloudpickle.register_pickle_by_value(base)
    cloudpickle.register_pickle_by_value(here)
    return function


def one_hot_columns(assigned: DataFrame, k: int, cluster: str = "cluster") -> tuple[DataFrame, list[str]]:
    """Add cluster_0..cluster_{k-1} beside the row's own columns; no join is involved."""
    names = [f"cluster_{i}" for i in range(k)]
    return assigned.withColumns({n: (F.col(cluster) == i).cast("double") for i, n in enumerate(names)}), names


def one_hot_vector(assigned: DataFrame, k: int, cluster: str = "cluster", name: str = "cluster_vector") -> DataFrame:
    """The same as one MLlib vector; every category keeps its slot."""
    sizes = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    encoder: OneHotEncoderModel = OneHotEncoder(inputCols=[cluster], outputCols=[name], dropLast=False).fit(sizes)
    return encoder.transform(assigned)


def append_features(df: DataFrame, features: Sequence[str], vector: str, name: str = "all_features") -> DataFrame:
    """One array of the plain features followed by a vector column's values."""
    return df.withColumn(name, F.concat(F.array(*[F.col(c).cast("double") for c in features]), vector_to_array(vector)))
