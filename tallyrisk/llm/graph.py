"""Connected components of an edge table by large-star and small-star rounds (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root) of every node of `edges` (u, v long): root is the smallest node it is connected with.

    Each round is two aggregations with partial sums and two joins. Minima are written before they are joined: both sides of a join
    are then plain tables, and AQE splits the rows of a node with very many neighbours. The number of rounds is logarithmic in the longest
    chain. Loops and repeated edges are allowed; a node without another has no row.
    """
    pairs = land(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = land(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), f"{label}-lowest")
        large = land(both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), f"{label}-large")
        best = land(large.groupBy("u").agg(F.min("v").alias("low")), f"{label}-best")
        small = large.join(best, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("low").alias("v")))).alias("e"))
        pairs = land(small.select("e.u", "e.v").filter("u <> v").distinct(), label)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if tuple(now) == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)
