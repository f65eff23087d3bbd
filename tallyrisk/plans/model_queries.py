"""Registered model queries. Where a fit cannot be written in SQL, the oracle holds what must be true of it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.functions.scalars import sigmoid
from tallyrisk.landing import SMALL_GROUPS, fresh_path, land
from tallyrisk.learn import anomaly as A
from tallyrisk.learn import attribution as AT
from tallyrisk.learn import calibrate as CA
from tallyrisk.learn import clusters as CL
from tallyrisk.learn import private as DP
from tallyrisk.learn import resample as RS
from tallyrisk.learn import supervised as SU
from tallyrisk.operators import curve as C
from tallyrisk.operators import report as R
from tallyrisk.operators.neighbours import knn_self_join
from tallyrisk.operators.segments import cluster_report
from tallyrisk.plans import workload as W
from tallyrisk.plans.registry import query
from tallyrisk.plans.sql_parts import TX
from tallyrisk.session import partitions_for, path_bytes

FLOOR = 0.1  # PR-AUC any fitted model must clear; the base rate is about 0.006
_X = ", ".join(W.FEATURES)


def part(spark, sf_dir, name):
    return W.transactions(spark, sf_dir).filter(F.col("split") == name)


def fit(spark, sf_dir, name: str, strategy: str = "weights") -> SU.Classifier:
    return _fit(spark, spark.sparkContext.applicationId, sf_dir, name, strategy)


@cache
def _fit(spark, _application, sf_dir, name, strategy):
    return SU.train(name, strategy, part(spark, sf_dir, "train"), part(spark, sf_dir, "val"), W.FEATURES)


def _checked(scored: DataFrame, by: list[str], floor: float = FLOOR) -> DataFrame:
    """rows, positives, scores in [0, 1], and PR-AUC above the floor, per group."""
    base = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range"))
    good = C.pr_auc(C.score_curve(scored, by=by), by).select(*by, (F.col("pr_auc") >= floor).alias("ranks"))
    return base.join(good, by)


_CHECKED = f"""WITH {TX} SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds, true AS in_range, true AS ranks
  FROM tx WHERE split <> 'train' GROUP BY split"""


def _later(spark, sf_dir):
    return W.transactions(spark, sf_dir).filter("split <> 'train'")


@query("class_weights", f"""WITH {TX}, c AS (SELECT count(*) FILTER (label=0)/CAST(count(*) FILTER (label=1) AS DOUBLE) AS w FROM tx WHERE split='train')
  SELECT label, count(*) AS rows, round(CASE WHEN label=1 THEN any_value(w) ELSE 1e0 END, 6) AS weight
  FROM tx, c WHERE split='train' GROUP BY label""")
def _(spark, sf_dir):
    weighted = RS.class_weights(part(spark, sf_dir, "train"))
    return weighted.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("weight"), 6).alias("weight"))


_DIST = " + ".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in W.FEATURES)


@query("knn_self_join", f"""WITH {TX}, m AS (SELECT seq, {_X} FROM tx WHERE split = 'train' AND label = 1)
  SELECT a.seq, CAST(row_number() OVER (PARTITION BY a.seq ORDER BY {_DIST}, b.seq) AS INTEGER) AS rank, b.seq AS neighbour_id,
    round(sqrt({_DIST}), 6) AS distance FROM m a JOIN m b ON a.seq <> b.seq
  QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY {_DIST}, b.seq) <= 5""")
def _(spark, sf_dir):
    minority = part(spark, sf_dir, "train").filter("label = 1")
    return knn_self_join(minority, W.FEATURES, 5, cell_rows=64).withColumn("distance", F.round("distance", 6))


_SMOTE = f"""WITH {TX}, c AS (SELECT count(*) FILTER (label=0) AS n, count(*) FILTER (label=1) AS p FROM tx WHERE split='train'),
  s AS (SELECT CAST(floor(CAST(0.1 AS DOUBLE)*n - p) AS BIGINT) AS made, n, p FROM c)"""


@query("smote", f"""{_SMOTE} SELECT synthetic, rows, frauds, true AS inside FROM (
  SELECT false AS synthetic, n+p AS rows, p AS frauds FROM s UNION ALL SELECT true, made, made FROM s)""")
def _(spark, sf_dir):
    """Synthetic rows must stay inside the bounding box of the real minority rows."""
    train = part(spark, sf_dir, "train")
    box = train.filter("label = 1").agg(*[f(c).alias(f"{n}_{c}") for c in W.FEATURES for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    out = RS.smote(train, W.FEATURES)
    inside = F.lit(True)
    for c in W.FEATURES:
        inside = inside & F.col(c).between(box[f"lo_{c}"], box[f"hi_{c}"])
    return out.groupBy("synthetic").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"),
                                        F.bool_and(inside | ~F.col("synthetic")).alias("inside"))


@query("resample_union", f"""{_SMOTE} SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) + any_value(made) AS frauds,
    count(*) + any_value(made) AS all_rows, round(sum(l_extendedprice), 2) AS real_amount FROM tx, s WHERE split='train'""")
def _(spark, sf_dir):
    """Resampling keeps every real row as it was."""
    out = RS.smote(part(spark, sf_dir, "train"), W.FEATURES, seed=3)
    real = ~F.col("synthetic")
    return out.agg(F.count_if(real).alias("rows"), F.sum("label").alias("frauds"), F.count(F.lit(1)).alias("all_rows"),
                   F.round(F.sum(F.when(real, F.col("l_extendedprice"))), 2).alias("real_amount"))


@query("train_logreg", _CHECKED)
def _(spark, sf_dir):
    return _checked(fit(spark, sf_dir, "logreg").score(_later(spark, sf_dir)), ["split"])


@query("train_random_forest", _CHECKED)
def _(spark, sf_dir):
    return _checked(fit(spark, sf_dir, "random_forest").score(_later(spark, sf_dir)), ["split"])


@query("train_gbt_depth", _CHECKED)
def _(spark, sf_dir):
    return _checked(fit(spark, sf_dir, "gbt_depth", "none").score(_later(spark, sf_dir)), ["split"])


@query("train_gbt_leafwise", _CHECKED)
def _(spark, sf_dir):
    return _checked(fit(spark, sf_dir, "gbt_leafwise", "none").score(_later(spark, sf_dir)), ["split"])


@query("model_grid", f"""{_SMOTE} SELECT model, strategy, CASE WHEN strategy = 'smote' THEN n+p+made ELSE n+p END AS n_train_rows,
    (SELECT CAST(sum(label) AS BIGINT) FROM tx WHERE split = 'test') AS positives, true AS ranks, true AS on_val, true AS ranking, true AS rates,
    true AS costs FROM s, (VALUES ('logreg'), ('random_forest'), ('gbt_depth'), ('gbt_leafwise')) m(model), (VALUES ('none'), ('weights'), ('smote')) t(strategy)""")
def _(spark, sf_dir):
    grid = land(SU.model_grid(W.transactions(spark, sf_dir), W.FEATURES)[0], "grid")
    measured = F.col("val_pr_auc").between(0.0, 1.0) & (F.col("fit_seconds") >= 0) & (F.col("best_iteration").isNotNull() == F.col("model").startswith("gbt"))
    return grid.select("model", "strategy", "n_train_rows", (F.col("tp") + F.col("fn")).alias("positives"),
                       (F.col("pr_auc") >= FLOOR).alias("ranks"), measured.alias("on_val"), *R.report_checks(F.lit(part(spark, sf_dir, "test").count())))


@query("batch_predict", f"WITH {TX} SELECT count(*) AS rows, count(DISTINCT seq) AS ids, min(seq) AS seq_from, max(seq) AS seq_to, true AS in_range FROM tx WHERE split = 'test'")
def _(spark, sf_dir):
    out = SU.batch_predict(fit(spark, sf_dir, "logreg"), part(spark, sf_dir, "test"), fresh_path(spark, "predictions"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("ids"), F.min("seq").alias("seq_from"),
                   F.max("seq").alias("seq_to"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


@query("score_range_chunks", f"WITH {TX} SELECT count(*) AS rows, count(*) AS same FROM tx WHERE split = 'test'")
def _(spark, sf_dir):
    """Scores of the id ranges, each written by itself, equal those of one bulk prediction row by row."""
    trained, test = fit(spark, sf_dir, "logreg"), part(spark, sf_dir, "test")
    whole = SU.batch_predict(trained, test, fresh_path(spark, "predictions"))
    chunked = SU.range_predict(trained, test, fresh_path(spark, "chunks"))
    both = whole.join(chunked.withColumnRenamed("score", "chunk_score"), "seq", "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") == F.col("chunk_score")).alias("same"))


# -- calibration

def _calibrated(spark, sf_dir):
    scored = W.scored(spark, sf_dir).select("seq", "split", "label", F.col("score_b").alias("score"))
    model = CA.isotonic_fit(scored.filter("split = 'val'"))
    return model, CA.calibrate(model, scored.filter("split = 'test'"))


@query("isotonic_calibrate", f"""WITH {TX}, v AS (SELECT avg(label) AS base FROM tx WHERE split = 'val')
  SELECT count(*) AS rows, true AS in_range, true AS keeps_order FROM tx WHERE split = 'test'""")
def _(spark, sf_dir):
    """Calibrated scores lie in [0, 1] and never fall while the raw score rises."""
    from pyspark.sql import Window

    _, cal = _calibrated(spark, sf_dir)
    tied = cal.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.max("calibrated").alias("high"), F.min("calibrated").alias("low"))
    block = F.floor(F.col("score") * 64)
    before = F.lag("high").over(Window.partitionBy(block).orderBy("score"))
    edges = tied.groupBy(block.alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ahead = F.lag("high").over(Window.orderBy("block"))  # 64 blocks
    ordered_edges = edges.select((F.coalesce(ahead, F.lit(0.0)) <= F.col("low") + 1e-12).alias("ok")).agg(
        F.bool_and("ok").alias("blocks_ok"))
    inside = tied.withColumn("ok", F.coalesce(before, F.lit(0.0)) <= F.col("low") + 1e-12).agg(
        F.sum("n").alias("rows"), F.bool_and(F.col("low").between(0, 1) & F.col("high").between(0, 1)).alias("in_range"),
        F.bool_and("ok").alias("rows_ok"))
    return R.beside(inside, ordered_edges).select("rows", "in_range", (F.col("rows_ok") & F.col("blocks_ok")).alias("keeps_order"))


@query("calibration_report", f"""WITH {TX} SELECT round(avg((score_b-label)*(score_b-label)), 6) AS brier_raw, true AS better,
  count(*) AS binned FROM tx WHERE split = 'test'""")
def _(spark, sf_dir):
    _, cal = _calibrated(spark, sf_dir)
    bins = CA.calibration_bins(cal).filter("kind = 'raw'").agg(F.sum("n").alias("binned"))
    return R.beside(CA.calibration_report(cal), bins).select("brier_raw", (F.col("brier_calibrated") < F.col("brier_raw")).alias("better"), "binned")


@query("calibrator_inverse", f"WITH {TX} SELECT count(*) AS test_rows, true AS smallest FROM tx WHERE split = 'test'")
def _(spark, sf_dir):
    """The raw threshold flags exactly what the calibrated one flags, up to the grid's step."""
    model, cal = _calibrated(spark, sf_dir)
    target = 0.05
    raw = CA.calibrator_inverse(spark, model, target).first()["raw_threshold"]
    step = 1.0 / (CA.INVERSE_GRID - 1)
    wrong = ((F.col("calibrated") >= target) & (F.col("score") < raw - step)) | ((F.col("calibrated") < target) & (F.col("score") >= raw))
    return cal.agg(F.count(F.lit(1)).alias("test_rows"), (F.count_if(wrong) == 0).alias("smallest"))


# -- unsupervised

def forest(spark, sf_dir) -> A.IsolationForest:
    return _forest(spark, spark.sparkContext.applicationId, sf_dir)


@cache
def _forest(spark, _application, sf_dir):
    legit = part(spark, sf_dir, "train").filter("label = 0")
    return A.isolation_forest(legit, W.FEATURES)


def bottleneck(spark, sf_dir) -> A.Reconstruction:
    return A.recon_error_fit(part(spark, sf_dir, "train").filter("label = 0"), W.FEATURES, 2)


def _anomalies(spark, sf_dir):
    # The last rows in time lie in the last files; dealt out, all cores walk them down the trees.
    test = part(spark, sf_dir, "test").repartition(max(2 * spark.sparkContext.defaultParallelism, partitions_for(path_bytes(spark, sf_dir))))
    wide = bottleneck(spark, sf_dir).score(forest(spark, sf_dir).score(test, "isolation_forest"), "reconstruction")
    return wide.select("seq", "label", "isolation_forest", "reconstruction")


@query("isolation_forest", f"WITH {TX} SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds, true AS in_range, true AS spread FROM tx WHERE split = 'test'")
def _(spark, sf_dir):
    out = _anomalies(spark, sf_dir)
    s = F.col("isolation_forest")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"), F.bool_and((s > 0) & (s < 1)).alias("in_range"),
                   (F.max(s) - F.min(s) > 0.05).alias("spread"))


@query("recon_error_score", f"WITH {TX} SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds, true AS non_negative, true AS bounded FROM tx WHERE split = 'train' AND label = 0")
def _(spark, sf_dir):
    """On the rows it was fitted to, two of four directions must lose less than everything."""
    legit = part(spark, sf_dir, "train").filter("label = 0")
    out = bottleneck(spark, sf_dir).score(legit)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"), F.bool_and(F.col("score") >= 0).alias("non_negative"),
                   F.avg("score").between(0.0, 1.0).alias("bounded"))


@query("anomaly_report", f"""WITH {TX} SELECT model, CAST(sum(label) AS BIGINT) AS positives, count(*) AS rows, true AS ranking, true AS rates, true AS costs
  FROM tx, (VALUES ('isolation_forest'), ('reconstruction')) m(model) WHERE split = 'test' GROUP BY model""")
def _(spark, sf_dir):
    wide = land(_anomalies(spark, sf_dir), "anomalies", group_bytes=SMALL_GROUPS)
    names = ["isolation_forest", "reconstruction"]
    report = land(R.report_by_model(wide, names), "anomaly-report")
    ranked = [F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(c) for c in names]
    counted = wide.agg(F.count(F.lit(1)).alias("rows"), *ranked).first()
    sizes = F.create_map(*[F.lit(v) for c in names for v in (c, counted[c])])
    return report.select("model", (F.col("tp") + F.col("fn")).alias("positives"), F.lit(counted["rows"]).alias("rows"),
                         *R.report_checks(sizes[F.col("model")]))


def _vectors(spark, sf_dir):
    """Embeddings as 64 plain columns; label 0 plays the rare class."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    rare = (F.col("label") == 0).cast("int").alias("label")
    return raw.select("vec_id", rare, *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def _embedded(spark, sf_dir):
    vectors, names = _vectors(spark, sf_dir)
    return A.recon_error_fit(vectors.filter("label = 0"), names).embed(vectors)


@query("embed", "SELECT count(*) AS rows, 8 AS width, true AS finite FROM embeddings")
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    out = _embedded(spark, sf_dir).select(vector_to_array("embedding").alias("z"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("z")).alias("width"),
                   F.bool_and(F.forall("z", lambda v: ~F.isnan(v))).alias("finite"))


@query("kmeans_segments", "SELECT count(*) AS rows, count(*) FILTER (label = 0) AS frauds, true AS valid FROM embeddings")
def _(spark, sf_dir):
    embedded = land(_embedded(spark, sf_dir).select("vec_id", "label", "embedding"), "embedded")
    model = CL.kmeans_segments(embedded)
    return model.transform(embedded).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"),
                                         F.bool_and(F.col("cluster").between(0, 11)).alias("valid"))


@query("cluster_report", """WITH a AS (SELECT CAST(vec_id % 12 AS INTEGER) AS c, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
  h AS (SELECT k AS cluster, count(y) AS rows, CAST(coalesce(sum(y), 0) AS BIGINT) AS frauds FROM range(14) t(k) LEFT JOIN a ON c = k GROUP BY k),
  r AS (SELECT *, CASE WHEN rows > 0 THEN frauds/CAST(rows AS DOUBLE) ELSE 0 END AS rate,
          sum(frauds) OVER ()/CAST(sum(rows) OVER () AS DOUBLE) AS base FROM h)
  SELECT CAST(cluster AS INTEGER) AS cluster, rows, frauds, round(rate, 5) AS fraud_rate, round(rate/base, 1) AS lift_vs_base FROM r""")
def _(spark, sf_dir):
    """Given assignments, with two clusters that hold nothing."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    given = raw.select(F.pmod("vec_id", F.lit(12)).cast("int").alias("cluster"), (F.col("label") == 0).cast("int").alias("label"))
    return cluster_report(given, 14)


@query("append_features", "SELECT count(*) AS rows, 76 AS width, count(*) AS ones FROM embeddings")
def _(spark, sf_dir):
    """64 features and a 12-slot one-hot on the same row."""
    vectors, names = _vectors(spark, sf_dir)
    assigned = vectors.withColumn("cluster", F.pmod("vec_id", F.lit(12)).cast("int"))
    out = CL.append_features(CL.one_hot_vector(assigned, 12), names, "cluster_vector")
    tail = F.slice("all_features", 65, 12)
    ones = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("all_features")).alias("width"), F.sum(ones).cast("long").alias("ones"))


@query("cluster_as_feature", _CHECKED)
def _(spark, sf_dir):
    """Refit with one-hot segments of the bottleneck beside the features."""
    table = W.transactions(spark, sf_dir)
    embedded = bottleneck(spark, sf_dir).embed(table)
    model = CL.kmeans_segments(embedded.filter("split = 'train'"), k=12)
    wide, names = CL.one_hot_columns(model.transform(embedded).drop("embedding"), 12)
    wide = land(wide, "with-clusters")
    trained = SU.train("logreg", "weights", wide.filter("split = 'train'"), wide.filter("split = 'val'"),
                       [*W.FEATURES, *names])
    return _checked(trained.score(wide.filter("split <> 'train'")), ["split"])


@query("feature_attribution", f"""WITH {TX} SELECT 4 AS features, true AS top_is_rule_input, m.model, least(2000, count(*)) AS explained, true AS adds_up,
  4 AS tree_features FROM tx, (VALUES ('gbt_depth'), ('random_forest')) m(model) WHERE split = 'test' GROUP BY m.model""")
def _(spark, sf_dir):
    """The label depends on discount and quantity, so one of them must lead; of trees, contributions and base must give each row's score."""
    test, train = part(spark, sf_dir, "test"), part(spark, sf_dir, "train")
    linear = AT.feature_attribution(fit(spark, sf_dir, "logreg"), test, train)
    lead = F.max_by("feature", "mean_abs_contribution").isin("l_quantity", "l_discount")
    first = linear.agg(F.count(F.lit(1)).cast("int").alias("features"), lead.alias("top_is_rule_input"))
    sample, out = AT.explained_sample(test), None
    for name in ("random_forest", "gbt_depth"):
        model = fit(spark, sf_dir, name)
        parts = land(AT.tree_contributions(model, sample), "contributions")
        total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
        told = sigmoid(total) if name == "gbt_depth" else total
        checked = parts.join(model.score(sample).select("seq", "score"), "seq").agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("explained"), F.bool_and(F.abs(told - F.col("score")) < 1e-9).alias("adds_up"))
        found = AT.mean_absolute(parts, model.features).agg(F.count_if(F.col("mean_abs_contribution") >= 0).cast("int").alias("tree_features"))
        row = R.beside(first, checked, found)
        out = row if out is None else out.unionByName(row)
    return out


@query("dp_train", f"WITH {TX} SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds, true AS in_range, true AS within_budget FROM tx WHERE split = 'test'")
def _(spark, sf_dir):
    model = DP.dp_train(part(spark, sf_dir, "train"), W.FEATURES, epsilon=3.0)
    out = model.score(part(spark, sf_dir, "test"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
                   F.lit(model.epsilon <= 3.0).alias("within_budget"))


@query("privacy_curve", f"""WITH {TX} SELECT e AS epsilon_target, CAST(sum(label) AS BIGINT) AS positives, true AS within_budget
  FROM tx, (VALUES ('inf'), ('8.0'), ('3.0'), ('1.0'), ('0.5')) v(e) WHERE split = 'test' GROUP BY e""")
def _(spark, sf_dir):
    curve = DP.privacy_curve(W.transactions(spark, sf_dir), W.FEATURES)
    target = F.try_to_number("epsilon_target", F.lit("9.9")).cast("double")
    return curve.select("epsilon_target", (F.col("tp") + F.col("fn")).alias("positives"),
                        F.coalesce(F.col("epsilon_spent") <= target, F.lit(True)).alias("within_budget"))


