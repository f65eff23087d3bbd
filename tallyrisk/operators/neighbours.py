"""Exact k nearest neighbours of every row among the same rows, without comparing all pairs.

Rows go to the cell of their nearest pivot. A first round finds each row's k nearest inside its own
cell, which bounds how far its true neighbours can be. A second round sends a row only to cells that
the triangle inequality cannot rule out at that distance. Both rounds compare a chunk of queries with
one cell's members in numpy and emit k rows per query. Full copies of a row are reduced to the first
k + 1 of each position beforehand, so no position can fill a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.operators.joins import balanced_join
from tallyrisk.operators.split import random_sample_fixed

CELL_ROWS = 2000
# What a task is sent at most; a larger table has larger cells, each searched in more blocks of the same size.
MAX_PIVOTS = 16384
QUERY_CHUNK, MEMBER_CHUNK = 4096, 32768
_BLOCK_VALUES = 4_000_000  # distances held at once in a task


def _slices(batch: pd.DataFrame, pivots: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of a batch with their distances to all pivots, _BLOCK_VALUES distances at a time."""
    step = max(1, _BLOCK_VALUES // max(1, len(pivots)))
    for at in range(0, len(batch), step):
        part = batch.iloc[at:at + step]
        yield part, _distances(_matrix(part["x"]), pivots)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _distances(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Euclidean distances from plain differences, one feature at a time."""
    total = np.zeros((len(queries), len(members)))
    for d in range(queries.shape[1]):
        gap = queries[:, d, None] - members[None, :, d]
        total += gap * gap
    return np.sqrt(total)


def _nearest(ids: np.ndarray, queries: np.ndarray, member_ids: np.ndarray, members: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest other members of each query; equal distances go by the lower id."""
    order = np.argsort(member_ids, kind="stable")
    member_ids, members = member_ids[order], members[order]
    parts = []
    step = max(1, _BLOCK_VALUES // max(1, len(members)))
    for start in range(0, len(ids), step):
        own = ids[start:start + step]
        dist = _distances(queries[start:start + step], members)
        dist[own[:, None] == member_ids[None, :]] = np.inf
        keep = min(k, dist.shape[1])
        limit = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
        rows, cols = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        found = dist[rows, cols]
        ranked = np.lexsort((cols, found, rows))
        rows, cols, found = rows[ranked], cols[ranked], found[ranked]
        first = np.searchsorted(rows, rows, side="left")
        top = np.arange(len(rows)) - first < k
        parts.append(pd.DataFrame({"id": own[rows[top]], "neighbour_id": member_ids[cols[top]], "distance": found[top]}))
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "neighbour_id": [], "distance": []})


def _search(visits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """k nearest members of the visited cell for every visiting row (id, x, cell)."""
    asked_in = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("asked"))
    held_in = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBER_CHUNK).cast("int").alias("held"))
    sizes = land(asked_in.join(held_in, "cell"), "knn-sizes")  # one row per cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    # Block (a, b) of a cell holds query chunk a and member chunk b, so a large cell is many small groups.
    asking = visits.join(sizes, "cell").select("id", "x", "cell", mine("id", "asked").alias("a"), every("held").alias("b"))
    named = members.select(F.col("id").alias("member_id"), F.col("x").alias("member_x"), F.col("cell").alias("member_cell"))
    held = named.join(sizes.select(F.col("cell").alias("member_cell"), "asked", "held"), "member_cell").select(
        "member_id", "member_x", "member_cell", every("asked").alias("member_a"), mine("member_id", "held").alias("member_b"))

    def one(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or block.empty:
            return pd.DataFrame({"id": [], "neighbour_id": [], "distance": []})
        return _nearest(asked["id"].to_numpy(), _matrix(asked["x"]), block["member_id"].to_numpy(),
                        _matrix(block["member_x"]), k)

    return asking.groupBy("cell", "a", "b").cogroup(held.groupBy("member_cell", "member_a", "member_b")).applyInPandas(
        one, "id long, neighbour_id long, distance double")


def knn_self_join(points: DataFrame, features: Sequence[str], k: int = 5, key: str = "seq",
                  cell_rows: int = CELL_ROWS, visit_cells: int | None = None) -> DataFrame:
    """(key, rank 1..k, neighbour_id, distance), ordered by distance and then by neighbour id.

    `key` is a unique long. Rows get fewer than k neighbours only if the table has k rows or fewer. In many dimensions
    the inequality rules out few cells; `visit_cells` then bounds the search to a row's nearest cells, at the price of
    some true neighbours. The default is exact.
    """
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = points.select(F.col(key).alias("id"), x.alias("x"))
    # Spark trims row_number <= k + 1 before the exchange, so a heavily repeated position stays small.
    copy = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    base = land(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1), "knn-base")
    total = base.count()
    wanted = min(max(1, -(-total // cell_rows)), MAX_PIVOTS)
    pivots = np.array([r["x"] for r in random_sample_fixed(base.select("id", "x"), wanted, "id", 17).collect()])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, dist in _slices(batch, pivots):
                cell = dist.argmin(axis=1)
                yield part[["id", "x"]].assign(cell=cell, radius=dist[np.arange(len(cell)), cell])

    placed = land(base.select("id", "x").mapInPandas(assign, "id long, x array<double>, cell long, radius double"),
                  "knn-cells")
    reach = np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row per pivot
        reach[r["cell"]] = r["radius"]

    own = land(_search(placed, placed, k), "knn-own")
    # Blocks of one cell report apart; the k-th best over them bounds the search.
    close = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    bound = (own.withColumn("near", close).filter(F.col("near") <= k)
             .groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("limit")))
    asking = placed.join(bound, "id", "left").select(
        "id", "x", "cell", F.when(F.col("found") >= k, F.col("limit")).otherwise(float("inf")).alias("limit"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, dist in _slices(batch, pivots):
                slack = 1e-9 * (1.0 + dist)
                open_ = dist - reach[None, :] <= part["limit"].to_numpy()[:, None] + slack
                open_ &= np.isfinite(reach)[None, :]
                open_[np.arange(len(part)), part["cell"].to_numpy()] = False
                if visit_cells is not None and dist.shape[1] > visit_cells + 1:
                    far = np.argsort(dist, axis=1)[:, visit_cells + 1:]
                    np.put_along_axis(open_, far, False, axis=1)
                row, cell = np.nonzero(open_)
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "cell": cell})

    found = own
    if wanted > 1:
        # Only ids and cells are written; a visitor's position is joined when it is compared.
        visits = land(asking.mapInPandas(route, "id long, cell long"), "knn-visits")
        found = own.unionByName(_search(visits.join(placed.select("id", "x"), "id"), placed, k))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour_id", "distance")
    # Copies beyond the first k + 1 of a position have the first k of them as neighbours.
    spare = rows.join(base.select("id"), "id", "left_anti")
    firsts = base.filter(F.col("copy") <= k).select("x", F.col("copy").alias("rank"), F.col("id").alias("neighbour_id"))
    extra = balanced_join(spare, firsts, ["x"]).select("id", "rank", "neighbour_id", F.lit(0.0).alias("distance"))
    return ranked.unionByName(extra).select(F.col("id").alias(key), "rank", "neighbour_id", "distance")
