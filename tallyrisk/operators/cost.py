"""Expected-cost curve over thresholds, read off the score curve.

Testing every threshold against every row costs rows x thresholds. Here each threshold's counts come
from the cumulative curve, which knows its next lower score: quantile thresholds from the point that
holds their rank, fixed ones from a binary search. Neither needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import decade_grid, double_array
from tallyrisk.operators.binning import add_bins
from tallyrisk.operators.curve import GROUP
from tallyrisk.operators.quantiles import lerp_expr


# What one positive below the threshold costs, and one row at or above it.
UNIT_COSTS = {"missed": 200.0, "flagged": 5.0}
GRID_POINTS = 400
LOG_FROM, LOG_TO = -6.0, 0.0


def quantile_thresholds(curve: DataFrame, points: int = GRID_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """Score quantiles on an even grid with tp and fp at or above each, per group.

    Which grid positions end in a curve point follows from the ranks it holds, and the lower end of an
    interpolation is at most one tie group below. So this is a projection of the curve: a cheap
    arithmetic filter keeps the few points next to a wanted rank, and nothing is shuffled.
    """
    n, cum = F.col("positives") + F.col("negatives"), F.col("tp") + F.col("fp")
    first_rank = (n - cum).cast("double")
    last_rank = (n - 1 - (cum - F.col("pos") - F.col("neg"))).cast("double")
    span, cells = F.greatest(n - 1, F.lit(1)).cast("double"), F.lit(float(points - 1))
    from_cell = F.ceil((first_rank - 2) / span * cells)
    to_cell = F.floor((last_rank + 1) / span * cells)
    prob = F.when(F.col("cell") == points - 1, 1.0).otherwise(F.col("cell") * F.lit(1.0 / (points - 1)))
    ends = (curve.withColumns({
                "n": n, "a": first_rank, "b": last_rank, "lo": F.greatest(from_cell - 1, F.lit(0)),
                "hi": F.when(n == 1, F.lit(points - 1)).otherwise(F.least(to_cell + 1, F.lit(points - 1)))})
            .filter(((n == 1) | (to_cell >= from_cell)) & (F.col("lo") <= F.col("hi")))
            .withColumn("cell", F.explode(F.sequence("lo", "hi")))
            .withColumn("position", prob * (F.col("n") - 1))
            .filter(F.ceil("position").between(F.col("a"), F.col("b"))))
    floor = F.floor("position")
    inside = floor >= F.col("a")
    value = F.when(inside, F.col("score")).otherwise(
        lerp_expr(F.col("next_score"), F.col("score"), F.col("position") - floor))
    below = ~inside & (value <= F.col("next_score"))
    return ends.select(
        *by, GROUP, value.alias("threshold"), "positives", "n",
        (F.col("tp") + F.when(below, F.col("next_pos")).otherwise(0)).alias("tp"),
        (F.col("fp") + F.when(below, F.col("next_neg")).otherwise(0)).alias("fp"))


def fixed_thresholds(curve: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tp and fp at or above each given threshold, per group.

    A threshold in (next lower score, score] has the counts of that score's point, and one above every
    score has none. Positions come from a binary search, so this too is a projection of the curve.
    """
    grid = sorted(set(map(float, thresholds)))
    splits = [float("-inf"), *grid, float("inf")]
    binned = add_bins(curve, {"score": splits, "next_score": splits})
    upto, after = F.col("score_bin"), F.coalesce("next_score_bin", F.lit(0))
    own = F.when(after < upto, F.sequence(after, upto - 1)).otherwise(F.array().cast("array<int>"))
    above = F.when((F.col("idx") == 0) & (upto < len(grid)), F.sequence(upto, F.lit(len(grid) - 1))) \
        .otherwise(F.array().cast("array<int>"))
    held = (binned.filter((after < upto) | (F.col("idx") == 0))
            .withColumn("slot", F.explode(F.concat(
                F.transform(own, lambda i: F.struct(i.alias("i"), F.lit(True).alias("reached"))),
                F.transform(above, lambda i: F.struct(i.alias("i"), F.lit(False).alias("reached")))))))
    reached = F.col("slot.reached")
    return held.select(
        *by, GROUP, F.get(double_array(grid), F.col("slot.i")).alias("threshold"), "positives",
        (F.col("positives") + F.col("negatives")).alias("n"),
        F.when(reached, F.col("tp")).otherwise(0).alias("tp"), F.when(reached, F.col("fp")).otherwise(0).alias("fp"))


def _all_thresholds(curve: DataFrame, points: int, by: Sequence[str]) -> DataFrame:
    return quantile_thresholds(curve, points, by).unionByName(
        fixed_thresholds(curve, decade_grid(LOG_FROM, LOG_TO, points), by))


def threshold_grid(curve: DataFrame, points: int = GRID_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """Distinct thresholds: score quantiles and a log-spaced grid, with tp and fp at each."""
    return _all_thresholds(curve, points, by).groupBy(*by, GROUP, "positives", "n", "threshold").agg(
        F.max("tp").alias("tp"), F.max("fp").alias("fp"))


def cost_expr(costs: Mapping[str, float]) -> Column:
    """Cost per 10,000 rows of a row holding missed, flagged and n."""
    total = sum(F.col(count) * F.lit(float(each)) for count, each in costs.items())
    return total / F.col("n") * F.lit(10000.0)


def cost_curve(curve: DataFrame, costs: Mapping[str, float] = UNIT_COSTS, points: int = GRID_POINTS,
               by: Sequence[str] = (), thresholds: Sequence[float] | None = None) -> DataFrame:
    """threshold, cost, missed, flagged at every threshold of the grid; `cost` is not rounded."""
    grid = threshold_grid(curve, points, by) if thresholds is None else fixed_thresholds(curve, thresholds, by)
    return _priced(grid, costs, by)


def _priced(grid: DataFrame, costs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    rows = grid.select(
        *by, GROUP, "threshold", "n", (F.col("positives") - F.col("tp")).alias("missed"),
        (F.col("tp") + F.col("fp")).alias("flagged"))
    return rows.select(*by, GROUP, "threshold", cost_expr(costs).alias("cost"), "missed", "flagged")


def best_cost(curve: DataFrame, costs: Mapping[str, float] = UNIT_COSTS, points: int = GRID_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """`cheapest` of the cost curve; repeated thresholds do no harm, so they are not removed first."""
    return cheapest(_priced(_all_thresholds(curve, points, by), costs, by), by)


def cheapest(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of least cost, the lowest one among equals."""
    best = F.min(F.struct("cost", "threshold", "missed", "flagged"))
    return costs.groupBy(*by, GROUP).agg(best.alias("best")).select(
        *by, GROUP, "best.threshold", F.round("best.cost", 2).alias("cost_per_10k"), "best.missed", "best.flagged")


def cost_at_threshold(costs: DataFrame, chosen: float, by: Sequence[str] = ()) -> DataFrame:
    """Cost at the first curve point at or above the chosen threshold; no row if there is none."""
    first = F.min(F.when(F.col("threshold") >= F.lit(chosen), F.struct("threshold", "cost")))
    return costs.groupBy(*by).agg(first.alias("first")).filter("first is not null").select(
        *by, "first.threshold", F.round("first.cost", 2).alias("cost_per_10k"))


def cost_baselines(df: DataFrame, label: str = "label", costs: Mapping[str, float] = UNIT_COSTS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Cost per 10,000 rows of flagging nothing and of flagging everything."""
    missed = F.sum(F.col(label)) * F.lit(float(costs["missed"])) / F.count(F.lit(1)) * F.lit(10000.0)
    return df.groupBy(*by).agg(
        F.round(missed, 2).alias("flag_nothing_cost_per_10k"),
        F.round(F.lit(costs["flagged"] * 10000.0), 2).alias("flag_everything_cost_per_10k"))
