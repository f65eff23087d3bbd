"""Population stability of features and scores against a reference window.

All features and all later windows are counted in one job: one scan bins every column, and the
grouped counts hold one row per (window, feature, bin).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import double_array, even_grid, psi_label, psi_term
from tallyrisk.operators.binning import add_bins, open_edges
from tallyrisk.operators.quantiles import column_quantiles


def reference_edges(reference: DataFrame, columns: Sequence[str], bins: int = 10,
                    rows: int | None = None) -> dict[str, list[float]]:
    """Unique quantile edges of each column on the reference rows."""
    found = column_quantiles(reference, columns, even_grid(bins + 1))
    return {c: sorted(set(found[c])) for c in columns}


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """Rows per (by, feature, bin) for all features in one pass; NULL and NaN are not counted."""
    splits = {c: open_edges(e) or [float("-inf"), float("inf")] for c, e in edges.items()}
    source = df.select(*by, *[F.col(c).cast("double").alias(c) for c in splits])
    binned = add_bins(source, splits)
    long = binned.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").alias("bin")) for c in splits])).alias("f"))
    return long.select(*by, "f.*").filter(F.col("bin").isNotNull()) \
        .groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("rows"))


def window_psi(df: DataFrame, columns: Sequence[str], window: str, reference: str, bins: int = 10,
               edges: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(window, feature, psi) of every other value of `window` against the reference window.

    Everything after the counts works on at most windows x features x bins rows.
    """
    if edges is None:
        edges = reference_edges(df.filter(F.col(window) == reference), columns, bins)
    counts = bin_counts(df, edges, [window])
    held = counts.groupBy(window, "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "rows"))).alias("held"), F.sum("rows").alias("total"))
    per_feature = Window.partitionBy("feature")  # one row per window
    is_reference = F.col(window) == reference
    beside = held.select(
        window, "feature", "held", "total",
        F.max_by("held", F.when(is_reference, 1)).over(per_feature).alias("ref_held"),
        F.max(F.when(is_reference, F.col("total"))).over(per_feature).alias("ref_total"))
    names = list(edges)
    cells = F.map_from_arrays(F.split(F.lit("\x1f".join(names)), "\x1f"),
                              double_array([max(len(open_edges(edges[c])) - 1, 1) for c in names]))
    last_bin = F.element_at(cells, F.col("feature")).cast("int") - 1

    def share(of: str, total: str, i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(of), i), F.lit(0)) / F.col(total)

    value = F.aggregate(F.sequence(F.lit(0), last_bin), F.lit(0.0), lambda total, i: total + psi_term(
        share("held", "total", i), share("ref_held", "ref_total", i)))
    return beside.filter(~is_reference).select(window, "feature", value.alias("psi"))


def with_status(report: DataFrame, decimals: int | None = 4) -> DataFrame:
    """Round psi first, then label the rounded value."""
    value = F.col("psi") if decimals is None else F.round("psi", decimals)
    return report.withColumn("psi", value).withColumn("status", psi_label(F.col("psi")))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the unrounded index of one column."""
    both = _tagged(reference, current, [column])
    return window_psi(both, [column], "_window", "reference", bins).select("feature", "psi")


def feature_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, psi (4 dp), status for every column; sort with `sort_report(.., 'psi')`."""
    both = _tagged(reference, current, columns)
    return with_status(window_psi(both, columns, "_window", "reference", bins)).select("feature", "psi", "status")


def _tagged(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (reference.select(F.lit("reference").alias("_window"), *columns)
            .unionByName(current.select(F.lit("current").alias("_window"), *columns)))


def drift_flagged(report: DataFrame) -> DataFrame:
    return report.filter(F.col("status") != "stable")


def drift_summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    top = F.max(F.struct("psi", "feature"))
    return report.groupBy(*by).agg(
        F.count(F.lit(1)).alias("features"), F.max("psi").alias("max_psi"), top.alias("top"),
        F.count_if(F.col("status") != "stable").alias("moderate_or_worse")).select(
        *by, "features", "max_psi", F.col("top.feature").alias("max_psi_feature"), "moderate_or_worse")


def psi_reference(df: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """One row `edges array<double>, reference array<double>`: what a stream compares its windows with."""
    edges = reference_edges(df, [score], bins)[score]
    cells = max(len(edges) - 1, 0)
    counts = bin_counts(df, {score: edges}).select("bin", "rows")
    pairs = F.map_from_entries(F.collect_list(F.struct("bin", "rows")))  # at most `bins` entries
    total = F.sum("rows")
    share = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)),
                        lambda i: F.coalesce(F.try_element_at(F.col("held"), i), F.lit(0)) / F.col("total"))
    return counts.agg(pairs.alias("held"), total.alias("total")).select(
        double_array(edges).alias("edges"), share.alias("reference"))


def histogram_columns(score: Column, edges: Sequence[float]) -> list[Column]:
    """One conditional count per bin: bin i holds scores below edge i+1 that no earlier bin holds.

    Plain aggregates, so windows get map-side partial sums. The last bin takes the rest.
    """
    inner = list(edges[1:-1])
    columns = []
    for i in range(len(edges) - 1):
        tests = []
        if i > 0:
            tests.append(score >= F.lit(inner[i - 1]))
        if i < len(inner):
            tests.append(score < F.lit(inner[i]))
        test = tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else score.isNotNull()
        columns.append(F.count_if(test).alias(f"bin_{i}"))
    return columns


def histogram_psi(events: Column, reference: Sequence[float]) -> Column:
    """Index of the `bin_i` counts against reference proportions."""
    total = F.lit(0.0)
    for i, share in enumerate(reference):
        total = total + psi_term(F.col(f"bin_{i}") / events, F.lit(float(share)))
    return total
