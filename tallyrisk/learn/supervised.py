"""Supervised models under the three imbalance strategies, chosen on validation only: MLlib's linear model, own forest and boosting."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.learn.boosting import PATIENCE, Binned, BoostedTrees, Boosting, Growth
from tallyrisk.learn.forest import Forestry, ForestTrees, random_forest
from tallyrisk.learn.resample import STRATEGIES, resample
from tallyrisk.operators.curve import best_f1_threshold, pr_auc, score_curve
from tallyrisk.operators.report import report_from_curve

# Model names and their settings.
SETTINGS: dict[str, dict] = {
    "logreg": {"C": 0.1, "maxIter": 2000},
    "random_forest": {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
    "gbt_depth": {"maxIter": 600, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureShare": 0.8, "minCurvature": 1.0, "l2": 1.0},
    "gbt_leafwise": {"maxIter": 600, "stepSize": 0.05, "numLeaves": 31, "subsamplingRate": 0.8, "featureShare": 0.8, "minInstancesPerNode": 20},
}
MODELS = tuple(SETTINGS)
# Fits of a grid that run side by side: most of a boosting pass is the fixed cost of a small job.
SIDE_BY_SIDE = 6


class Classifier:
    """A fitted MLlib pipeline or ensemble of trees over `features`, and its row of facts for reports."""

    def __init__(self, fitted: PipelineModel | BoostedTrees, features: Sequence[str], **facts):
        self.fitted, self.features, self.facts = fitted, list(features), facts

    @property
    def pipeline(self) -> PipelineModel:
        if isinstance(self.fitted, BoostedTrees):
            raise TypeError("a model of own trees is no MLlib pipeline")
        return self.fitted

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """`df` with the probability of the positive class."""
        if isinstance(self.fitted, BoostedTrees):
            return self.fitted.score(df, name)
        return self.fitted.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)

    def save(self, spark: SparkSession, path: str) -> None:
        """Replace what is at `path` by the model: MLlib's own format, or Parquet tables of nodes and bins."""
        if isinstance(self.fitted, BoostedTrees):
            self.fitted.save(spark, path)
        else:
            self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: Sequence[str], **facts) -> Classifier:
        """What `save` wrote; the facts name the model."""
        kept = {"gbt_depth": BoostedTrees, "gbt_leafwise": BoostedTrees, "random_forest": ForestTrees}.get(facts["model"])
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stages")  # forests were MLlib pipelines once
        if kept is None or target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return cls(PipelineModel.load(path), features, **facts)
        return cls(kept.load(spark, path), features, **facts)


def _assembler(features: Sequence[str], output: str = "_features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output)


def make_pipeline(name: str, features: Sequence[str], label: str, seed: int, weight_sum: float, **overrides) -> Pipeline:
    _known(name)
    s = {**SETTINGS[name], **overrides}
    common = {"labelCol": label, "weightCol": "weight"}
    # C scales the summed loss there and regParam the penalty on the mean loss here.
    reg = 1.0 / (s.pop("C") * weight_sum)
    return Pipeline(stages=[_assembler(features, "_raw"),
                            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="_features", regParam=reg, standardization=False, **common, **s)])


def _known(name: str) -> None:
    if name not in SETTINGS:
        raise ValueError(f"model must be one of {MODELS}")


def growth(name: str, **overrides) -> Growth:
    """How the trees of a boosted model grow."""
    s = {**SETTINGS[name], **overrides}
    return Growth(s.get("numLeaves"), s.get("maxDepth"), s.get("minInstancesPerNode", 1), s.get("minCurvature", 1e-3), s.get("l2", 0.0),
                  s["stepSize"], s.get("subsamplingRate", 1.0), s.get("featureShare", 1.0))


def train(name: str, strategy: str, train_df: DataFrame, val_df: DataFrame, features: Sequence[str], label: str = "label",
          seed: int = 0, key: str = "seq", prepared: DataFrame | None = None, patience: int = PATIENCE, start: Binned | None = None, **overrides) -> Classifier:
    """Fit one model under one strategy; boosted models keep the best round on validation and stop `patience` rounds behind it.

    `prepared` is what `resample` makes of the training rows, `start` what boosting makes of those, where they are at hand.
    """
    _known(name)
    rows = prepared if prepared is not None else land(resample(train_df, features, strategy, label, seed, key), "fit")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    began = time.perf_counter()
    settings = {**SETTINGS[name], **overrides}
    facts = {"model": name, "strategy": strategy, "n_train_rows": size["n"], "best_iteration": None}
    if name.startswith("gbt"):
        boosting = Boosting(rows, val_df, features, growth(name, **overrides), label, seed=seed, start=start).run(settings["maxIter"], patience)
        out = Classifier(boosting.close(), features, **facts)
        out.facts["best_iteration"] = boosting.best_rounds - 1
    elif name == "random_forest":
        out = Classifier(random_forest(rows, features, Forestry(**settings), label, size["n"], seed=seed), features, **facts)
    else:
        out = Classifier(make_pipeline(name, features, label, seed, size["w"], **settings).fit(rows), features, **facts)
    out.facts["fit_seconds"] = round(time.perf_counter() - began, 2)
    return out


def model_grid(table: DataFrame, features: Sequence[str], models: Sequence[str] = MODELS,
               strategies: Sequence[str] = STRATEGIES, label: str = "label", seed: int = 0,
               overrides: dict[str, dict] | None = None) -> tuple[DataFrame, dict[tuple[str, str], Classifier]]:
    """Report rows of every model x strategy and the fitted models.

    Thresholds come from validation best-F1, reports from test. Each strategy's training rows are
    made once, and SIDE_BY_SIDE fits share the cores (`fit_seconds` is what a fit took among the others);
    both slices of all fits are then measured together in one report.
    """
    parts = {s: table.filter(F.col("split") == s) for s in ("train", "val", "test")}
    prepared = {s: land(resample(parts["train"], features, s, label, seed), f"fit-{s}") for s in strategies}

    boosted = any(name.startswith("gbt") for name in models)

    def fit(job: tuple[str, str]) -> Classifier:
        name, strategy = job
        return train(name, strategy, parts["train"], parts["val"], features, label, seed, prepared=prepared[strategy],
                     start=starts.get(strategy) if name.startswith("gbt") else None, **(overrides or {}).get(name, {}))

    # Boosting takes longest, so it begins first.
    jobs = sorted(((name, strategy) for strategy in strategies for name in models), key=lambda job: -models.index(job[0]))
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        starts = dict(zip(strategies, pool.map(lambda s: Binned(prepared[s], parts["val"], features, label), strategies if boosted else ())))
        fitted = dict(zip(jobs, pool.map(fit, jobs)))
    for start in starts.values():
        start.close()
    # Later rows are read once and take the scores of all fits, a column each.
    wide, columns = table.filter(F.col("split") != "train"), [f"_score_{i}" for i in range(len(fitted))]
    for t, column in zip(fitted.values(), columns):
        wide = t.score(wide, column)
    wide = land(wide.select("split", F.col(label).alias("label"), *columns), "grid-scores", partition_by=["split"])
    told = [F.struct(F.lit(name).alias("model"), F.lit(strategy).alias("strategy"), F.col(c).alias("score")) for (name, strategy), c in zip(fitted, columns)]
    by, scored = ["model", "strategy"], wide.select("split", "label", F.inline(F.array(*told)))
    on_val = score_curve(scored.filter("split = 'val'"), by=by)
    chosen = best_f1_threshold(on_val, by)
    report = report_from_curve(score_curve(scored.filter("split = 'test'"), by=by), chosen, by)
    facts = table.sparkSession.createDataFrame(
        [(n, s, i, t.facts["fit_seconds"], t.facts["n_train_rows"], t.facts["best_iteration"])
         for i, ((n, s), t) in enumerate(sorted(fitted.items(), key=lambda f: (models.index(f[0][0]), strategies.index(f[0][1]))))],
        "model string, strategy string, run_idx int, fit_seconds double, n_train_rows long, best_iteration int")
    val = pr_auc(on_val, by).select(*by, F.round("pr_auc", 4).alias("val_pr_auc"))
    return facts.join(val, by).join(report, by), fitted


def batch_predict(trained: Classifier, df: DataFrame, path: str, key: str = "seq") -> DataFrame:
    """Score a whole slice to Parquet and return what was written."""
    trained.score(df).select(key, "score").write.parquet(path)
    return df.sparkSession.read.schema(f"{key} long, score double").parquet(path)


def range_predict(trained: Classifier, df: DataFrame, path: str, key: str = "seq", chunks: int = 8) -> DataFrame:
    """Score a slice in ranges of ids, each range a file of its own, and return what was written."""
    ranged = df.repartitionByRange(chunks, key)
    trained.score(ranged).select(key, "score", F.spark_partition_id().alias("chunk")).write.partitionBy("chunk").parquet(path)
    return df.sparkSession.read.schema(f"{key} long, score double, chunk int").parquet(path).select(key, "score")
