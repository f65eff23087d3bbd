"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Inside a shard each vector gets one more coordinate that brings all to the shard's largest norm, and a query a zero; the
order by Euclidean distance is then the order by inner product, so that the triangle inequality applies. A side of a node is
skipped where the inequality rules out anything nearer than FACTOR times the distance of the k-th best so far. With a factor of
one the search is exact; a smaller one skips more.

A block of queries walks a shard's tree together: the queries of one side of a node go on as one matrix. Scores are row sums
of products of the original vectors in double precision, which do not depend on the block or shard a row is in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import query, table

# Neighbours, pruning factor, rows of a leaf, and values (rows x length) of a shard and of a block of queries.
NEIGHBOURS, FACTOR, LEAF, SHARD_VALUES, BLOCK_VALUES = 20, 0.8, 256, 1 << 20, 1 << 17
MOST_TASKS = 20_000  # of one search; a task may hold several pairs of a shard and a block, one after another


class VantageTree:
    """Tree over the rows of one shard. `nodes` holds (vantage row, radius, inside, outside) or (rows,) of a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.reach = float(square.max()) if len(square) else 0.0
        self.lift = np.sqrt(np.maximum(self.reach - square, 0.0))
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) <= LEAF:
            return at
        v = rows[self.rng.integers(len(rows))]
        near = self.vectors[rows] @ self.vectors[v] + self.lift[rows] * self.lift[v]
        distance = np.sqrt(np.maximum(2 * self.reach - 2 * near, 0.0))
        radius = np.partition(distance, len(rows) // 2)[len(rows) // 2]
        inside = distance <= radius
        if inside.all():
            inside = distance < radius
        if not inside.any():  # all at one distance: no ball tells them apart
            return at
        radius = float(distance[inside].max())
        outer = float(distance[~inside].min())
        self.nodes[at] = (v, radius, outer, self._grow(rows[inside]), self._grow(rows[~inside]))
        return at

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query, best first and ties to smaller ids; -1 and -inf fill up."""
        n = len(queries)
        best_id, best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        square = np.einsum("ij,ij->i", queries, queries) + self.reach
        slack = 1e-9 * (square + 1.0)

        def tau(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows] - 2 * best[rows, -1], 0.0))

        def leaf(rows: np.ndarray, members: np.ndarray) -> None:
            """A matrix product finds the pairs that could enter a list; only those get the exact score."""
            rough = queries[rows] @ self.vectors[members].T
            near = rough >= (best[rows, -1] - slack[rows])[:, None]
            near &= own[rows][:, None] != self.ids[members][None]
            r, m = np.nonzero(near)
            if not len(r):
                return
            score = np.empty(len(r))
            for i in range(0, len(r), 1 << 14):
                score[i:i + (1 << 14)] = (queries[rows[r[i:i + (1 << 14)]]] * self.vectors[members[m[i:i + (1 << 14)]]]).sum(-1)
            width = np.bincount(r, minlength=len(rows))
            hit = np.flatnonzero(width)
            slot = np.arange(len(r)) - np.repeat(np.cumsum(width[hit]) - width[hit], width[hit])
            line = np.repeat(np.arange(len(hit)), width[hit])
            more_id, more = np.full((len(hit), width.max()), -1, np.int64), np.full((len(hit), width.max()), -np.inf)
            more_id[line, slot], more[line, slot] = self.ids[members[m]], score
            part = rows[hit]
            ids, score = np.concatenate([best_id[part], more_id], 1), np.concatenate([best[part], more], 1)
            order = np.lexsort((ids, -score), axis=-1)[:, :k]
            best_id[part], best[part] = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            entry = self.nodes[node]
            if len(entry) == 1:
                for i in range(0, len(entry[0]), 4 * LEAF):
                    leaf(rows, entry[0][i:i + 4 * LEAF])
                return
            v, radius, outer, inside, outside = entry
            distance = np.sqrt(np.maximum(square[rows] - 2 * (queries[rows] @ self.vectors[v]), 0.0))
            within = distance <= (radius + outer) / 2
            visit(inside, rows[within])
            visit(outside, rows[~within])
            # Nothing outside is nearer than outer - distance, nothing inside nearer than distance - radius.
            limit = factor * tau(rows) + 1e-9
            visit(outside, rows[within & (outer - distance <= limit)])
            visit(inside, rows[~within & (distance - radius <= limit)])

        visit(self.root, np.arange(n))
        return best_id, best


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, length, row): no rows with a NULL id or a NULL, empty, zero or non-finite vector; `row` numbers them."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return (vectors.filter(F.col(id_col).isNotNull() & fine & F.exists(vector, lambda x: x != 0))
            .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
            .withColumn("length", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_values: int = SHARD_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): each query's k nearest of all other rows, by largest inner product.

    `is_query` tells from the id column `id` which rows are queries. Every block of queries meets every shard of its vector
    length, so that a task holds one shard and one block whatever the table's size. Vectors of other lengths are not compared.
    An empty table, or one without queries, gives no rows.

    Rows that share an id are rows of their own: each is found, so that a list may name an id more than once, and each that is
    a query gets a list of its own, told apart by `query_row`. A query is not answered with rows of its own id.
    """
    usable = land(_usable(vectors, id_col, vector_col), "vectors")
    sizes = usable.groupBy("length").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("n_queries"))
    plan = sizes.select("length", F.ceil(F.col("n") * F.col("length") / F.lit(shard_values)).cast("int").alias("shards"),
                        F.greatest(F.lit(1), F.ceil(F.col("n_queries") * F.col("length") / F.lit(block_values)).cast("int")).alias("blocks"))
    planned = usable.join(plan, "length")
    pairs = plan.agg(F.sum(F.col("shards").cast("long") * F.col("blocks"))).first()[0]

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    members = (planned.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.col("shards")).cast("int"))
               .withColumn("block", every("blocks")).select("length", "shard", "block", "id", "row", "vector"))
    asked = (planned.filter(is_query).withColumn("block", F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks")).cast("int"))
             .withColumn("shard", every("shards")).select("length", "shard", "block", "id", "row", "vector"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        shard, block = rows[~rows["asked"]], rows[rows["asked"]]
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "query_row": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"),
                                 "score": np.zeros(0)})
        shard = shard.sort_values(["id", "row"])
        tree = VantageTree(shard["id"].to_numpy(np.int64), np.stack(shard["vector"].to_list()).astype(np.float64))
        own = block["id"].to_numpy(np.int64)
        ids, scores = tree.search(own, np.stack(block["vector"].to_list()).astype(np.float64), k, factor)
        found = ids >= 0
        each = found.sum(1)
        return pd.DataFrame({"query_id": np.repeat(own, each), "query_row": np.repeat(block["row"].to_numpy(np.int64), each),
                             "vec_id": ids[found], "score": scores[found]})

    keys = ["length", "shard", "block"]
    together = members.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    # Pairs of a shard and a block are few bytes and much work, so they are spread by number and not merged by size.
    spread = together.repartition(min(max(pairs or 0, 1), MOST_TASKS), *keys)
    found = spread.groupBy(*keys).applyInPandas(search, "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "query_row"))


@query("op4_vantage_trees")
def op4(spark, sf_dir):
    """query_id, rank, vec_id, score, query_row of the 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
