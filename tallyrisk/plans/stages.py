"""The evaluation stages as Spark jobs, and the promotion lifecycle.

    python -m tallyrisk.plans.stages <stage> --input TABLE --out DIR [--features a,b] [--label y] [--sample 0.05]

Stages: data, train, evaluate, privacy, drift, all. A stage reads the split table that `data` wrote
and leaves its reports as JSON directories; models stay in MLlib's own format.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.landing import land, release
from tallyrisk.learn import anomaly as A
from tallyrisk.learn import attribution as AT
from tallyrisk.learn import calibrate as CA
from tallyrisk.learn import clusters as CL
from tallyrisk.learn import private as DP
from tallyrisk.learn import supervised as SU
from tallyrisk.learn.resample import STRATEGIES
from tallyrisk.operators import cost as K
from tallyrisk.operators import curve as C
from tallyrisk.operators import drift as D
from tallyrisk.operators import quality as Q
from tallyrisk.operators import report as R
from tallyrisk.operators import split as S
from tallyrisk.operators import stream_reports as P
from tallyrisk.operators.segments import cluster_report
from tallyrisk.sources.transactions import CARD_FEATURES, TARGET, filter_legit, scan_transactions, write_report

SEEDS = (0, 1, 2, 3, 4)  # fixed values
# Candidates of the lifecycle run, in the order that settles ties.
CANDIDATES = (("gbt_depth", "weights"), ("gbt_leafwise", "weights"), ("gbt_depth", "none"))


@dataclass
class Run:
    """Where a run reads and writes, and how its models are sized."""

    spark: SparkSession
    out: str
    features: list[str] = field(default_factory=lambda: list(CARD_FEATURES))
    amount: str | None = "Amount"
    models: Sequence[str] = SU.MODELS
    strategies: Sequence[str] = STRATEGIES
    overrides: dict[str, dict] = field(default_factory=dict)
    clusters: int = CL.CLUSTERS
    starts: int = CL.STARTS
    forest: dict = field(default_factory=dict)
    bottleneck: int = A.BOTTLENECK
    dp_steps: int = 30
    seeds: Sequence[int] = SEEDS

    def save(self, name: str, report: DataFrame) -> DataFrame:
        path = f"{self.out}/reports/{name}"
        write_report(report, path)
        return self.spark.read.schema(report.schema).json(path)

    def table(self) -> DataFrame:
        """The split table; `data` wrote it with one directory per slice."""
        return self.spark.read.parquet(f"{self.out}/split")

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/best_scores")

    def best(self) -> dict:
        return self.spark.read.json(f"{self.out}/reports/best").first().asDict()


def stage_data(run: Run, source: DataFrame, label: str = TARGET, sample: float = 1.0, seq: str = "seq") -> DataFrame:
    """Split by time and write the slices. `source` carries `seq`."""
    rows = source.withColumn("label", F.col(label).cast("int")).select(seq, *run.features, "label")
    if sample < 1.0:
        rows = S.time_prefix_sample(rows, sample, seq)
    S.time_split(rows, seq=seq).write.partitionBy("split").parquet(f"{run.out}/split")
    return run.save("split", S.split_summary(run.table(), seq=seq))


def stage_train(run: Run) -> DataFrame:
    """Every model x strategy; the best on validation is kept with its scores on all slices."""
    table = run.table()
    grid, fitted = SU.model_grid(table, run.features, run.models, run.strategies, overrides=run.overrides)
    saved = run.save("baselines", grid)
    chosen = run.save("best", P.model_select(saved)).first()
    best = fitted[chosen["model"], chosen["strategy"]]
    best.save(run.spark, f"{run.out}/best_model")
    best.score(table).select("seq", "split", "label", *run.features, "score").write.partitionBy("split").parquet(f"{run.out}/best_scores")
    return saved


def load_best(run: Run) -> SU.Classifier:
    return SU.Classifier.load(run.spark, f"{run.out}/best_model", run.features, **run.best())


def stage_evaluate(run: Run) -> dict[str, DataFrame]:
    """Anomaly detectors, segments, calibration, cost threshold, attribution, seed stability."""
    table, scores = run.table(), run.scores()
    train, val, test = (table.filter(F.col("split") == s) for s in ("train", "val", "test"))
    best, out = load_best(run), {}

    legit = filter_legit(table)
    forest = A.isolation_forest(legit, run.features, **run.forest)
    reduced = A.recon_error_fit(legit, run.features, run.bottleneck)
    wide = land(reduced.score(forest.score(test, "isolation_forest"), "reconstruction")
                .select("label", "isolation_forest", "reconstruction"), "anomalies")
    out["anomaly"] = run.save("anomaly", R.report_by_model(wide, ["isolation_forest", "reconstruction"]))

    embedded = land(reduced.embed(table).drop("_embedding"), "embedded", ["split"])
    segments = CL.kmeans_segments(embedded.filter("split = 'train'"), run.clusters, run.starts)
    assigned = land(segments.transform(embedded).drop("embedding"), "assigned", ["split"])
    out["clusters"] = run.save("clusters", cluster_report(assigned.filter("split <> 'val'"), run.clusters, by=["split"]))
    wide, names = CL.one_hot_columns(assigned, run.clusters)
    with_clusters = SU.train(best.facts["model"], best.facts["strategy"], wide.filter("split = 'train'"), wide.filter("split = 'val'"),
                             [*run.features, *names], **run.overrides.get(best.facts["model"], {}))
    both = with_clusters.score(wide.filter("split <> 'train'")).select("split", "label", "score", F.lit("with_cluster_onehot").alias("kind"))
    both = both.unionByName(scores.filter("split <> 'train'").select("split", "label", "score", F.lit("without").alias("kind")))
    by = ["kind", "split"]
    out["cluster_as_feature"] = run.save("cluster_as_feature", C.pr_auc(C.score_curve(both, by=by), by).withColumn("pr_auc", F.round("pr_auc", 4)))

    calibrator = CA.isotonic_fit(scores.filter("split = 'val'"))
    calibrator.write().overwrite().save(f"{run.out}/calibrator")
    calibrated = land(CA.calibrate(calibrator, scores.filter("split <> 'train'")), "calibrated", ["split"])
    on_test = calibrated.filter("split = 'test'")
    out["calibration"] = run.save("calibration", CA.calibration_report(on_test))
    out["reliability"] = run.save("reliability", CA.calibration_bins(on_test))

    val_costs = K.cost_curve(C.score_curve(calibrated.filter("split = 'val'"), "calibrated"))
    threshold = K.cheapest(val_costs).first()["threshold"]
    test_costs = land(K.cost_curve(C.score_curve(on_test, "calibrated")).drop(C.GROUP), "test-costs")
    out["cost_curve"] = run.save("cost_curve", C.every_kth(test_costs, 4, ["threshold"]))
    out["cost"] = run.save("cost", R.beside(
        C.confusion_at_threshold(on_test, threshold, "calibrated"),
        K.cost_at_threshold(test_costs, threshold).select("cost_per_10k"), K.cost_baselines(on_test),
        CA.calibrator_inverse(run.spark, calibrator, threshold)))

    out["attribution"] = run.save("attribution", AT.feature_attribution(best, test, train))
    repeats = []
    for seed in run.seeds:
        t = SU.train(best.facts["model"], best.facts["strategy"], train, val, run.features, seed=seed, **run.overrides.get(best.facts["model"], {}))
        repeats.append(t.score(test).select("label", "score", F.lit(seed).alias("seed")))
    long = repeats[0]
    for part in repeats[1:]:
        long = long.unionByName(part)
    out["stability"] = run.save("stability", P.seed_stability(C.pr_auc(C.score_curve(long, by=["seed"]), ["seed"]), "pr_auc"))
    return out


def stage_privacy(run: Run) -> DataFrame:
    return run.save("privacy", DP.privacy_curve(run.table(), run.features, steps=run.dp_steps))


def stage_drift(run: Run) -> DataFrame:
    """Features and score of validation and both test halves against the training window."""
    scores, kept = run.scores(), [*run.features, "score"]
    halves = S.split_halves(scores.filter("split = 'test'"))
    windows = scores.filter("split <> 'test'").select(F.col("split").alias("win"), *kept).unionByName(
        halves.select(F.concat(F.lit("test_"), F.col("half"), F.lit("_half")).alias("win"), *kept))
    return run.save("drift", D.with_status(D.window_psi(windows, [*run.features, "score"], "win", "train")))


@dataclass(frozen=True)
class Promotion:
    passed: bool
    test_pr_auc: float
    champion_pr_auc: float
    seconds: float


def lifecycle(run: Run, registry: str, candidates: Sequence[tuple[str, str]] = CANDIDATES, floor: float = Q.PR_AUC_FLOOR) -> Promotion:
    """validate, train candidates, report on test, gate, register, batch-predict; drift beside it."""
    began = time.perf_counter()
    table = run.table()
    train, val, test = (table.filter(F.col("split") == s) for s in ("train", "val", "test"))
    run.save("validation", Q.require_valid(Q.validate_table(train, run.features, "label", run.amount)))
    fits = [SU.train(n, s, train, val, run.features, **run.overrides.get(n, {})) for n, s in candidates]
    long = None
    for i, t in enumerate(fits):
        part = t.score(val).select("label", "score", F.lit(i).alias("run_idx"))
        long = part if long is None else long.unionByName(part)
    on_val = C.score_curve(long, by=["run_idx"])
    rows = C.pr_auc(on_val, ["run_idx"]).join(C.best_f1_threshold(on_val, ["run_idx"]), "run_idx")
    chosen = P.model_select(rows, "pr_auc").first()
    best = fits[chosen["run_idx"]]
    best.save(run.spark, f"{run.out}/model")
    report = run.save("test_report", R.full_report(best.score(test), threshold=chosen["threshold"]))
    measured = report.first()["pr_auc"]
    gate = Q.promotion_gate(Q.read_registry(run.spark, registry), measured, floor).first()
    if gate["passed"]:
        row = [(best.facts["model"], best.facts["strategy"], chosen["threshold"], round(chosen["pr_auc"], 4), measured)]
        candidate = run.spark.createDataFrame(row, "model string, strategy string, threshold double, val_pr_auc double, test_pr_auc double")
        Q.registry_append(registry, candidate.withColumn("created_at", F.current_timestamp()))
        SU.batch_predict(best, test, f"{run.out}/predictions")
    drift = D.feature_drift(train, test, run.features)
    run.save("drift_summary", D.drift_summary(drift))
    return Promotion(gate["passed"], measured, gate["champion_pr_auc"], round(time.perf_counter() - began, 1))


def main() -> None:
    from tallyrisk.session import build_session

    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("stage", choices=["data", "train", "evaluate", "privacy", "drift", "all"])
    ap.add_argument("--input", help="Parquet transaction table (for data and all)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--features", default=",".join(CARD_FEATURES))
    ap.add_argument("--label", default=TARGET)
    ap.add_argument("--order", default="", help="columns that give the time order when the table has no seq")
    ap.add_argument("--sample", type=float, default=1.0)
    ap.add_argument("--clusters", type=int, default=CL.CLUSTERS)
    ap.add_argument("--dp-steps", type=int, default=30)
    a = ap.parse_args()
    run = Run(build_session(), a.out, a.features.split(","), clusters=a.clusters, dp_steps=a.dp_steps)
    stages = ["data", "train", "evaluate", "privacy", "drift"] if a.stage == "all" else [a.stage]
    for name in stages:
        if name == "data":
            source = scan_transactions(run.spark, a.input, a.label, order=[c for c in a.order.split(",") if c])
            stage_data(run, source, a.label, a.sample)
        else:
            {"train": stage_train, "evaluate": stage_evaluate, "privacy": stage_privacy, "drift": stage_drift}[name](run)
        release(run.spark)  # reports and slices are under --out; what a stage wrote in between is not needed again
        print(f"{name}: reports under {a.out}/reports", flush=True)


if __name__ == "__main__":
    main()
