"""Mean absolute contribution per feature on a seeded sample: exact for linear models and trees, sampled walks for any other scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.learn.boosting import BoostedTrees
from tallyrisk.learn.shapley import boosted_leaves, contributions, forest_leaves
from tallyrisk.learn.supervised import Classifier
from tallyrisk.operators.split import random_sample_fixed, top_k

SAMPLE_ROWS, TOP_FEATURES = 2000, 12  # fixed values


def linear_attribution(trained: Classifier, df: DataFrame, background: DataFrame) -> DataFrame:
    """Exact for a linear model: coefficient times distance from the background mean, on the logit."""
    _, scaler, regression = trained.pipeline.stages
    means = background.agg(*[F.avg(c).alias(c) for c in trained.features]).first()
    weights = [b / (s or 1.0) for b, s in zip(regression.coefficients, scaler.std)]
    parts = [F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in zip(trained.features, weights)]
    wide = df.agg(*parts)
    return wide.unpivot([], list(trained.features), "feature", "mean_abs_contribution")


def sampled_attribution(score: Callable[[DataFrame], DataFrame], sample: DataFrame, features: Sequence[str],
                        permutations: int = 4, key: str = "seq", seed: int = 0) -> DataFrame:
    """Monte-Carlo Shapley values: walk from another sampled row to the row, one feature at a time.

    For every sampled row and permutation the d + 1 stages of the walk become rows, all stages are
    scored in one pass, and each step's change goes to the feature it switched. Work is sample rows x
    permutations x (d + 1), whatever the table size.
    """
    d = len(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    held = land(sample.select(F.col(key).alias("id"), x.alias("x")), "explained")
    ranked = held.withColumn("slot", F.row_number().over(Window.orderBy("id")) - 1)  # the sample, a bounded table
    size = ranked.count()
    walks = ranked.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    walks = walks.withColumn("other", F.pmod(F.xxhash64("id", "walk", F.lit(seed)), F.lit(max(size, 1))))
    base = ranked.select(F.col("slot").alias("other"), F.col("x").alias("b"))
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                 lambda f: F.struct(F.xxhash64("id", "walk", f, F.lit(seed + 1)).alias("h"), f.alias("f")))),
        lambda s: s["f"])
    stages = (walks.join(base, "other").withColumn("order", order)
              .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d)))))
    switched = F.slice("order", F.lit(1), F.col("step"))
    columns = [F.when(F.array_contains(switched, i), F.col("x")[i]).otherwise(F.col("b")[i]).alias(c)
               for i, c in enumerate(features)]
    scored = score(stages.select("id", "walk", "step", "order", *columns))
    before = F.lag("score").over(Window.partitionBy("id", "walk").orderBy("step"))
    moved = (scored.withColumn("delta", F.col("score") - before).filter(F.col("step") > 0)
             .withColumn("index", F.get("order", F.col("step") - 1)))
    value = moved.groupBy("id", "index").agg(F.avg("delta").alias("value"))
    names = F.array(*[F.lit(c) for c in features])
    return value.groupBy("index").agg(F.avg(F.abs("value")).alias("mean_abs_contribution")).select(
        F.get(names, F.col("index")).alias("feature"), "mean_abs_contribution")


def tree_contributions(trained: Classifier, df: DataFrame, key: str = "seq") -> DataFrame:
    """(key, contributions in the order of the features, base) of every row: exact path-dependent Shapley values.

    Contributions and base add up to the probability of a forest and to the margin of a boosted model.
    """
    if isinstance(trained.fitted, BoostedTrees):
        leaves = boosted_leaves(trained.fitted)
    else:
        leaves = forest_leaves(df.sparkSession, trained.fitted.stages[-1], len(trained.features))
    return contributions(df, leaves, trained.features, key)


def mean_absolute(contributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs_contribution) over rows with an array `contributions`."""
    parts = [F.avg(F.abs(F.col("contributions")[i])).alias(c) for i, c in enumerate(features)]
    return contributed.agg(*parts).unpivot([], list(features), "feature", "mean_abs_contribution")


def explained_sample(df: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "seq", seed: int = 0) -> DataFrame:
    """A fixed-size sample, dealt over all cores: few rows, much work each."""
    sample = land(random_sample_fixed(df, sample_rows, key, seed), "explained")
    return sample.repartition(df.sparkSession.sparkContext.defaultParallelism)


def feature_attribution(trained: Classifier, df: DataFrame, background: DataFrame, sample_rows: int = SAMPLE_ROWS,
                        k: int = TOP_FEATURES, key: str = "seq", seed: int = 0) -> DataFrame:
    """The k features with the largest mean absolute contribution on a fixed-size sample of `df`."""
    sample = explained_sample(df, sample_rows, key, seed)
    if trained.facts["model"] == "logreg":
        found = linear_attribution(trained, sample, background)
    else:
        found = mean_absolute(tree_contributions(trained, sample, key), trained.features)
    return top_k(found, "mean_abs_contribution", k, ["feature"])
