"""Exact quantiles with linear interpolation, at any size.

Approximate quantiles give a bracket around each wanted rank, rows outside the brackets collapse to one
counted row per gap, and the few rows inside are ranked by the distributed running total. If a bracket
misses, the ranking runs on all values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.operators.binning import add_bins
from tallyrisk.operators.order import running_totals

BRACKET_ACCURACY = 20_000


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """{column: value at each probability}; NULL and NaN are not counted; empty columns give []."""
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    values = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    return _bracketed(values, list(columns), list(probs))


def _bracketed(values: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    slack = 2.0 / BRACKET_ACCURACY
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    row = values.agg(*[F.percentile_approx(c, low + high, BRACKET_ACCURACY).alias(f"q_{c}") for c in columns],
                     *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    counts = {c: row[f"n_{c}"] for c in columns}
    splits = {}
    for c in columns:
        if counts[c]:
            found = row[f"q_{c}"]
            splits[c] = _bracket_splits(list(zip(found[:len(probs)], found[len(probs):])))
    answers: dict[str, list[float]] = {c: [] for c in columns}
    if not splits:
        return answers
    binned = add_bins(values.select(*splits), splits)
    # Odd bins are brackets: their values stay apart. Even bins are gaps: one counted row each.
    long = binned.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_bin").alias("bin"), F.col(c).alias("value"))
        for c in splits])).alias("v")).select("v.*").filter(F.col("value").isNotNull())
    reduced = long.groupBy("column", "bin", F.when(F.col("bin") % 2 == 1, F.col("value")).alias("value")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    picked = _pick(reduced, {c: _ranks(counts[c], probs) for c in splits})
    missed = [c for c in splits if any(picked[c].get(r) is None for r in _ranks(counts[c], probs))]
    if missed:
        whole = values.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(1).alias("bin"), F.col(c).alias("value"))
            for c in missed])).alias("v")).select("v.*").filter(F.col("value").isNotNull())
        picked.update(_pick(whole.groupBy("column", "bin", "value").agg(F.count(F.lit(1)).alias("rows")),
                            {c: _ranks(counts[c], probs) for c in missed}))
    for c in splits:
        answers[c] = [interpolate(picked[c], counts[c], p) for p in probs]
    return answers


def _bracket_splits(pairs: list[tuple[float, float]]) -> list[float]:
    """Merge overlapping closed brackets into boundaries: gap, bracket, gap, bracket, ..., gap."""
    merged: list[list[float]] = []
    for low, high in sorted(pairs):
        if merged and low <= math.nextafter(merged[-1][1], math.inf):
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    bounds = [float("-inf")]
    for low, high in merged:
        bounds += [low, math.nextafter(high, math.inf)]
    return [*bounds, float("inf")]


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    wanted = set()
    for p in probs:
        position = p * (n - 1)
        wanted |= {math.floor(position), math.ceil(position)}
    return sorted(wanted)


def _pick(counted: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Value at each rank per column; the answer has as many rows as there are wanted ranks."""
    totals = running_totals(counted, "column", [F.col("bin").asc(), F.col("value").asc()], ["rows"])
    wanted = F.create_map(*[item for c, r in ranks.items() for item in (F.lit(c), F.array(*map(F.lit, map(int, r))))])
    covered = F.filter(wanted[F.col("column")],
                       lambda r: (r < F.col("run_rows")) & (r >= F.col("run_rows") - F.col("rows")))
    hits = totals.select("column", "value", F.explode(covered).alias("rank"))
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for row in hits.collect():
        found[row["column"]][row["rank"]] = row["value"]
    return found


def interpolate(at_rank: dict[int, float], n: int, p: float) -> float:
    position = p * (n - 1)
    low, high = at_rank[math.floor(position)], at_rank[math.ceil(position)]
    return lerp(low, high, position - math.floor(position))


def lerp(low: float, high: float, share: float) -> float:
    """Linear interpolation taken from the nearer end, exact at both ends."""
    gap = high - low
    return high - gap * (1 - share) if share >= 0.5 else low + gap * share


def lerp_expr(low: Column, high: Column, share: Column) -> Column:
    gap = high - low
    return F.when(share >= 0.5, high - gap * (1 - share)).otherwise(low + gap * share)


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Unique quantiles at bins + 1 even probabilities."""
    from tallyrisk.functions.scalars import even_grid

    return sorted(set(column_quantiles(df, [column], even_grid(bins + 1))[column]))
