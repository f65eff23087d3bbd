"""Half-open bins by binary search inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_edges(edges: Sequence[float]) -> list[float]:
    """Unique edges with the outer two opened to -inf and +inf; fewer than two edges give no bin."""
    unique = sorted(set(edges))
    if len(unique) < 2:
        return []
    return [float("-inf"), *unique[1:-1], float("inf")]


def add_bins(df: DataFrame, splits: Mapping[str, Sequence[float]], suffix: str = "_bin") -> DataFrame:
    """Add `<column>_bin`: the index of the right-open bin that holds the value, NULL for NULL or NaN.

    `splits` are full boundaries including -inf and +inf. Columns with a single bin get bin 0.
    """
    searched = {name: list(bounds) for name, bounds in splits.items() if len(bounds) > 2}
    if searched:
        names = list(searched)
        out = Bucketizer(inputCols=names, outputCols=[f"_raw_{n}" for n in names],
                         splitsArray=[searched[n] for n in names], handleInvalid="keep").transform(df)
    else:
        out = df
    columns = {}
    for name in splits:
        known = F.col(name).isNotNull() & ~F.isnan(F.col(name))
        index = F.col(f"_raw_{name}").cast("int") if name in searched else F.lit(0)
        columns[f"{name}{suffix}"] = F.when(known, index)
    return out.withColumns(columns).drop(*[f"_raw_{n}" for n in searched])
