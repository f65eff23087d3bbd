"""Cumulative score curve and the ranking metrics that read it.

`score_curve` collapses rows to distinct scores (partial aggregation first, so a score shared by a
third of all rows shuffles one row per task), then adds running true and false positives in
descending score order. Every metric below is one aggregation over that landed curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import ratio
from tallyrisk.operators.order import index_within, running_totals

GROUP = "_group"


def group_tag(by: Sequence[str]) -> Column:
    """One non-null text value per combination of the `by` columns."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def score_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (and group): pos, neg, tp, fp, positives, negatives, next_*.

    tp and fp count rows with a score at or above the row's; next_* are the next lower tie group's. Rows whose score is NULL or NaN or whose
    label is NULL cannot be ranked and are left out; `validate_table` reports them.
    """
    scored = df.select(*by, F.col(score).cast("double").alias("score"),
                       F.col(label).cast("long").alias("label"))
    scored = scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull())
    return curve_of_counts(scored.groupBy(*by, "score").agg(
        F.sum("label").alias("pos"), (F.count(F.lit(1)) - F.sum("label")).alias("neg")), by)


def curve_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve of a table that holds each distinct score once, with its positives and negatives."""
    distinct = counts.withColumn(GROUP, group_tag(by))
    totals = running_totals(distinct, GROUP, [F.col("score").desc()], ["pos", "neg"], ["score", "pos", "neg"])
    return totals.select(
        *by, GROUP, "score", "pos", "neg",
        F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"),
        F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"),
        "next_score", "next_pos", "next_neg", F.col("place").alias("idx"), F.col("places").alias("points"))


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return ratio(F.col("tp"), F.col("positives"))


def _f1() -> Column:
    """F1 with its denominator floored, in the operation order that keeps float ties the same."""
    p, r = _precision(), _recall()
    return F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-12))


def pr_auc_expr() -> Column:
    """Average precision: the step sum of recall gains times precision; 0.0 without positives."""
    gain = ratio(F.col("pos"), F.col("positives")) * _precision()
    return F.sum(F.when(F.col("pos") > 0, gain).otherwise(0.0))


def roc_auc_expr() -> Column:
    """Area under ROC, tied pairs counted half; NULL when a class is missing."""
    above = F.col("tp").cast("double") - F.col("pos") / 2
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return F.when(pairs > 0, F.sum(F.col("neg") * above) / pairs)


def recall_at_fpr_expr(cap: float) -> Column:
    """Struct (recall, threshold): best recall with FPR at or below `cap`, highest such threshold."""
    fpr = ratio(F.col("fp"), F.col("negatives"))
    best = F.max(F.when(fpr <= F.lit(cap), F.struct(_recall().alias("recall"), F.col("score").alias("threshold"))))
    nothing = F.struct(F.lit(0.0).alias("recall"), F.lit(float("inf")).alias("threshold"))
    # A qualifying prefix that catches nobody ties with the empty prefix, whose threshold is higher.
    return F.when(best["recall"] > 0, best).otherwise(nothing)


def best_f1_expr() -> Column:
    """Struct (f1, threshold): largest F1, lowest threshold among equals."""
    top = F.max(F.struct(_f1().alias("f1"), (-F.col("score")).alias("minus")))
    return F.struct(top["f1"].alias("f1"), (-top["minus"]).alias("threshold"))


def pr_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(pr_auc_expr().alias("pr_auc"))


def roc_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(roc_auc_expr().alias("roc_auc"))


def recall_at_fpr(curve: DataFrame, cap: float, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(recall_at_fpr_expr(cap).alias("best")).select(*by, "best.recall", "best.threshold")


def best_f1_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(best_f1_expr().alias("best")).select(*by, "best.threshold", "best.f1")


def confusion_expr(threshold: Column, score: str = "score", label: str = "label") -> list[Column]:
    """Aggregates of one scan: tp, fp, fn at a threshold that may be a column."""
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    return [F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
            F.count_if(~flagged & positive).alias("fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Add flagged, precision, recall and f1 to a frame holding tp, fp and fn."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (counts.withColumn("flagged", F.col("tp") + F.col("fp"))
            .withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def confusion_at_threshold(df: DataFrame, threshold: float, score: str = "score", label: str = "label",
                           by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(*confusion_expr(F.lit(threshold), score, label))
    return with_rates(counts.withColumn("threshold", F.lit(float(threshold)))).select(
        *by, "threshold", "precision", "recall", "f1", "flagged", "tp", "fp", "fn")


def confusion_matrix(df: DataFrame, threshold: float, score: str = "score", label: str = "label",
                     by: Sequence[str] = ()) -> DataFrame:
    """Rows actual x predicted with their counts, empty cells kept."""
    counts = df.groupBy(*by).agg(
        *confusion_expr(F.lit(threshold), score, label),
        F.count_if((F.col(score) < threshold) & (F.col(label) != 1)).alias("tn"))
    cells = F.array(*[F.struct(F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"),
                               F.col(name).alias("rows"))
                      for actual, predicted, name in (("legit", "legit", "tn"), ("legit", "fraud", "fp"),
                                                      ("fraud", "legit", "fn"), ("fraud", "fraud", "tp"))])
    return counts.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def roc_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points with collinear interior points left out, (0, 0) first at threshold +inf.

    A point is interior when the next tie group adds the same numbers of both classes. What is left
    holds at most about two points per tie group with positives, however many negatives there are.
    """
    first, last = F.col("idx") == 0, F.col("idx") == F.col("points") - 1
    bend = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    kept = curve.filter(first | last | bend).select(
        *by, GROUP, "score",
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"), _recall().alias("tpr"))
    origin = curve.filter(first).select(*by, GROUP, F.lit(float("inf")).alias("score"),
                                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = index_within(origin.unionByName(kept), [GROUP], [F.col("score").desc()])
    sizes = points.groupBy(GROUP).agg(F.count(F.lit(1)).alias("points"))
    return points.join(sizes, GROUP).select(*by, GROUP, "idx", "points", F.col("score").alias("threshold"), "fpr", "tpr")


def curve_downsample(curve: DataFrame, limit: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """At most `limit` ROC points at evenly spaced positions; the +inf threshold is shown as 1.0."""
    points = roc_points(curve, by)
    size = F.least(F.col("points"), F.lit(limit))
    # Position i of the grid is the truncation of i * step; a point is kept if some i lands on it.
    step = (F.col("points") - 1) / F.greatest(size - 1, F.lit(1))
    near = F.floor(F.col("idx") / step)
    lands = F.exists(
        F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 1, size - 1)),
        lambda i: F.when(i == size - 1, F.col("points") - 1).otherwise(F.floor(i * step)) == F.col("idx"))
    kept = points.filter((F.col("points") <= limit) | lands)
    return kept.select(*by, "fpr", "tpr",
                       F.when(F.col("threshold") == float("inf"), 1.0).otherwise(F.col("threshold")).alias("threshold"))


def every_kth(points: DataFrame, k: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """Every k-th row in order, starting with the first, for a report-sized curve."""
    return index_within(points, by, order).filter(F.col("idx") % k == 0)
