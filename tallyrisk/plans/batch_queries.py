"""Registered batch queries: scans, splits, metrics, drift, quality, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.functions import scalars as X
from tallyrisk.landing import fresh_path, land
from tallyrisk.operators import cost as K
from tallyrisk.operators import curve as C
from tallyrisk.operators import drift as D
from tallyrisk.operators import joins as J
from tallyrisk.operators import order as O
from tallyrisk.operators import quality as Q
from tallyrisk.operators import quantiles as N
from tallyrisk.operators import report as R
from tallyrisk.operators import split as S
from tallyrisk.operators import stream_reports as P
from tallyrisk.plans import workload as W
from tallyrisk.plans.registry import query
from tallyrisk.plans.sql_parts import COST, CURVE, EV, LONG, REPORT, TX, drift_ctes, iso, report_select
from tallyrisk.session import partitions_for, path_bytes
from tallyrisk.sources import events as E
from tallyrisk.sources import sinks
from tallyrisk.sources import transactions as T

BY = ["split", "model"]
FEATURE_LIST = ", ".join(W.FEATURES)
T_SQL = f"CAST({W.THRESHOLD} AS DOUBLE)"


def _six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _long(spark, sf_dir):
    return W.with_scores(W.split_rows(spark, sf_dir)).unpivot(["split", "label"], ["score_a", "score_b"], "model", "score")


_CURVES: dict[tuple, object] = {}


def shared_curve(spark, sf_dir):
    """The curve of both rule scores by split, computed once per session and read by every metric."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CURVES:
        _CURVES[key] = land(C.score_curve(_long(spark, sf_dir), by=BY), "curve")
    return _CURVES[key]


# -- scans and sinks

@query("scan_transactions", f"WITH {TX} SELECT seq, {FEATURE_LIST}, label FROM tx")
def _(spark, sf_dir):
    path = fresh_path(spark, "raw")
    files = max(3, partitions_for(path_bytes(spark, f"{sf_dir}/lineitem.parquet")))
    W.raw_lineitem(spark, sf_dir).withColumn("label", W.label_rule().cast("string")).repartition(files, "l_orderkey").write.parquet(path)
    return T.scan_transactions(spark, path, "label", order=W.TIME_ORDER).select("seq", *W.FEATURES, "label")


@query("sink_split_parts", f"WITH {TX} SELECT split, seq, label, l_extendedprice FROM tx")
def _(spark, sf_dir):
    path = fresh_path(spark, "parts")
    T.write_split_parts(W.transactions(spark, sf_dir), path)
    return spark.read.parquet(path).select("split", "seq", "label", "l_extendedprice")


@query("export_instances", f"""WITH {TX} SELECT count(*) AS lines, round(sum(l_quantity), 2) AS sum_quantity,
  round(sum(l_tax), 2) AS sum_tax FROM tx WHERE split = 'test'""")
def _(spark, sf_dir):
    path = fresh_path(spark, "instances")
    T.export_instances(W.transactions(spark, sf_dir).filter("split = 'test'"), W.FEATURES, path)
    row = F.from_json("value", "array<double>")
    return spark.read.text(path).select(row.alias("x")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("x")[0]), 2).alias("sum_quantity"),
        F.round(F.sum(F.col("x")[3]), 2).alias("sum_tax"))


@query("sink_report", f"""WITH {TX} SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds
  FROM tx GROUP BY split""")
def _(spark, sf_dir):
    path = fresh_path(spark, "report")
    T.write_report(S.split_summary(W.transactions(spark, sf_dir)), path)
    return spark.read.schema("split string, rows long, frauds long").json(path)


# -- projections and filters

@query("project_features", f"SELECT {FEATURE_LIST} FROM lineitem")
def _(spark, sf_dir):
    return T.project_features(W.raw_lineitem(spark, sf_dir), W.FEATURES)


@query("filter_legit", f"WITH {TX} SELECT seq, l_extendedprice FROM tx WHERE split = 'train' AND label = 0")
def _(spark, sf_dir):
    return T.filter_legit(W.transactions(spark, sf_dir)).select("seq", "l_extendedprice")


@query("flag_threshold", f"WITH {TX} SELECT seq, score_a, score_a >= {T_SQL} AS is_alert FROM tx")
def _(spark, sf_dir):
    return W.scored(spark, sf_dir).select("seq", "score_a", (F.col("score_a") >= W.THRESHOLD).alias("is_alert"))


@query("filter_alerts", f"WITH {TX} SELECT seq, score_b, label FROM tx WHERE score_b >= {T_SQL}")
def _(spark, sf_dir):
    return W.scored(spark, sf_dir).filter(F.col("score_b") >= W.THRESHOLD).select("seq", "score_b", "label")


@query("split_halves", f"""WITH {TX}, b AS (SELECT split, min(seq) AS lo, count(*) AS n FROM tx GROUP BY split)
  SELECT CASE WHEN seq < lo + n//2 THEN 'first' ELSE 'second' END AS half, count(*) AS rows,
    CAST(sum(label) AS BIGINT) AS frauds, min(seq * seq) AS seq_from, max(seq * seq) AS seq_to
  FROM tx JOIN b USING (split) WHERE split = 'test' GROUP BY 1""")
def _(spark, sf_dir):
    # Squared positions leave gaps, so that halves by rank and by value differ.
    halves = S.split_halves(W.transactions(spark, sf_dir).filter("split = 'test'").withColumn("seq", F.col("seq") * F.col("seq")))
    return halves.groupBy("half").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("frauds"),
                                      F.min("seq").alias("seq_from"), F.max("seq").alias("seq_to"))


# -- ordering, splits, samples

@query("global_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return O.global_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query("time_split", f"WITH {TX} SELECT seq, split FROM tx")
def _(spark, sf_dir):
    return S.time_split(W.transactions(spark, sf_dir).drop("split"), dense=True).select("seq", "split")


@query("split_summary", f"""WITH {TX} SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS frauds,
  round(avg(label), 6) AS fraud_rate, min(seq) AS seq_from, max(seq) AS seq_to FROM tx GROUP BY split""")
def _(spark, sf_dir):
    return S.split_summary(W.transactions(spark, sf_dir))


@query("time_prefix_sample", f"""WITH {TX} SELECT seq, label FROM tx, cuts
  WHERE seq < floor(n*CAST(0.05 AS DOUBLE))""")
def _(spark, sf_dir):
    return S.time_prefix_sample(W.transactions(spark, sf_dir), 0.05, dense=True).select("seq", "label")


@query("random_sample_fixed", f"""WITH {TX} SELECT least(2000, count(*)) AS rows, least(2000, count(*)) AS ids,
  true AS all_test FROM tx WHERE split = 'test'""")
def _(spark, sf_dir):
    tx = W.transactions(spark, sf_dir)
    drawn = S.random_sample_fixed(tx.filter("split = 'test'"), 2000)
    return drawn.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("ids"),
                     F.bool_and(F.col("split") == "test").alias("all_test"))


@query("head_n", f"WITH {TX} SELECT seq * seq AS seq, label FROM tx, cuts WHERE split = 'test' AND seq < c2 + 100")
def _(spark, sf_dir):
    sparse = W.transactions(spark, sf_dir).filter("split = 'test'").withColumn("seq", F.col("seq") * F.col("seq"))
    return S.head_n(sparse, 100).select("seq", "label")


@query("every_kth", f"""WITH {COST}, ordered AS (SELECT split, model, threshold, round(cost, 2) AS cost_per_10k,
    row_number() OVER (PARTITION BY split, model ORDER BY threshold) - 1 AS idx FROM priced)
  SELECT split, model, count(*) AS points, round(sum(cost_per_10k)/count(*), 1) AS mean_cost FROM ordered
  WHERE idx % 4 = 0 GROUP BY split, model""")
def _(spark, sf_dir):
    costs = K.cost_curve(shared_curve(spark, sf_dir), by=BY)
    kept = C.every_kth(costs.withColumn("cost_per_10k", F.round("cost", 2)), 4, ["threshold"], by=BY)
    return kept.groupBy(*BY).agg(F.count(F.lit(1)).alias("points"),
                                 F.round(F.avg("cost_per_10k"), 1).alias("mean_cost"))


_ROC = CURVE + """,
roc AS (SELECT split, model, CAST('infinity' AS DOUBLE) AS threshold, 0e0 AS fpr, 0e0 AS tpr FROM curve WHERE idx = 0
        UNION ALL
        SELECT split, model, score, CASE WHEN negatives=0 THEN 0 ELSE fp/CAST(negatives AS DOUBLE) END, r FROM prf
        WHERE idx = 0 OR idx = points-1 OR pos <> next_pos OR neg <> next_neg),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, model ORDER BY threshold DESC) - 1 AS i,
             count(*) OVER (PARTITION BY split, model) AS n FROM roc),
wanted AS (SELECT DISTINCT split, model, CASE WHEN k = least(n, 200)-1 THEN n-1
             ELSE CAST(floor(k*((n-1)/CAST(greatest(least(n, 200)-1, 1) AS DOUBLE))) AS BIGINT) END AS i
           FROM (SELECT DISTINCT split, model, n FROM placed), range(200) t(k) WHERE k < least(n, 200))"""


@query("curve_downsample", f"""WITH {_ROC} SELECT split, model, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr,
  round(CASE WHEN threshold = 'infinity' THEN 1e0 ELSE threshold END, 6) AS threshold
  FROM placed JOIN wanted USING (split, model, i)""")
def _(spark, sf_dir):
    points = C.curve_downsample(shared_curve(spark, sf_dir), 200, BY)
    return points.select(*BY, *_six("fpr", "tpr", "threshold"))


# -- evaluation metrics

@query("score_curve", f"WITH {CURVE} SELECT split, model, score, pos, neg, tp, fp, idx FROM curve")
def _(spark, sf_dir):
    return C.score_curve(_long(spark, sf_dir), by=BY).select(
        *BY, "score", "pos", "neg", "tp", "fp", "idx")


@query("confusion_at_threshold", f"""WITH {LONG}, c AS (SELECT split, model,
    count(*) FILTER (score >= {T_SQL} AND label = 1) AS tp, count(*) FILTER (score >= {T_SQL} AND label = 0) AS fp,
    count(*) FILTER (score < {T_SQL} AND label = 1) AS fn FROM long GROUP BY split, model)
  SELECT split, model, {T_SQL} AS threshold, tp, fp, fn, tp+fp AS flagged,
    round(CASE WHEN tp+fp=0 THEN 0 ELSE tp/CAST(tp+fp AS DOUBLE) END, 6) AS precision,
    round(CASE WHEN tp+fn=0 THEN 0 ELSE tp/CAST(tp+fn AS DOUBLE) END, 6) AS recall,
    round(CASE WHEN tp=0 THEN 0 ELSE 2e0*tp/(2*tp+fp+fn) END, 6) AS f1 FROM c""")
def _(spark, sf_dir):
    return C.confusion_at_threshold(_long(spark, sf_dir), W.THRESHOLD, by=BY).select(
        *BY, "threshold", "tp", "fp", "fn", "flagged", *_six("precision", "recall", "f1"))


@query("confusion_matrix", f"""WITH {LONG} SELECT split, model, CASE WHEN a = 1 THEN 'fraud' ELSE 'legit' END AS actual,
    CASE WHEN p = 1 THEN 'fraud' ELSE 'legit' END AS predicted,
    count(*) FILTER (label = a AND CAST(score >= {T_SQL} AS INTEGER) = p) AS rows
  FROM long, range(2) x(a), range(2) y(p) GROUP BY ALL""")
def _(spark, sf_dir):
    return C.confusion_matrix(_long(spark, sf_dir), W.THRESHOLD, by=BY)


@query("pr_auc", f"WITH {REPORT} SELECT split, model, round(pr_auc, 6) AS pr_auc FROM ranked")
def _(spark, sf_dir):
    return C.pr_auc(C.score_curve(_long(spark, sf_dir), by=BY), BY).select(*BY, *_six("pr_auc"))


@query("roc_auc", f"WITH {REPORT} SELECT split, model, round(roc_auc, 6) AS roc_auc FROM ranked")
def _(spark, sf_dir):
    return C.roc_auc(shared_curve(spark, sf_dir), BY).select(*BY, *_six("roc_auc"))


@query("recall_at_fpr", f"""WITH {CURVE}, ok AS (SELECT split, model, cap, r, score FROM prf,
    (VALUES (1e-3), (1e-2)) v(cap) WHERE fp/CAST(negatives AS DOUBLE) <= cap AND r > 0
    QUALIFY row_number() OVER (PARTITION BY split, model, cap ORDER BY r DESC, score DESC) = 1)
  SELECT g.split, g.model, cap, round(coalesce(r, 0), 6) AS recall, round(coalesce(score, -1), 6) AS threshold
  FROM (SELECT DISTINCT split, model, cap FROM tied, (VALUES (1e-3), (1e-2)) v(cap)) g
  LEFT JOIN ok USING (split, model, cap)""")
def _(spark, sf_dir):
    curve = shared_curve(spark, sf_dir)
    both = [C.recall_at_fpr(curve, cap, BY).withColumn("cap", F.lit(cap)) for cap in (0.001, 0.01)]
    shown = F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.round("threshold", 6))
    return both[0].unionByName(both[1]).select(*BY, "cap", *_six("recall"), shown.alias("threshold"))


@query("best_f1_threshold", f"WITH {CURVE} SELECT split, model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best_f1")
def _(spark, sf_dir):
    return C.best_f1_threshold(shared_curve(spark, sf_dir), BY).select(*BY, *_six("threshold", "f1"))


@query("threshold_grid", f"""WITH {COST} SELECT split, model, count(*) BETWEEN 400 AND 800 AS in_bounds,
  round(min(threshold), 6) AS lowest, max(threshold) AS highest FROM priced GROUP BY split, model""")
def _(spark, sf_dir):
    grid = K.threshold_grid(shared_curve(spark, sf_dir), by=BY)
    return grid.groupBy(*BY).agg(F.count(F.lit(1)).between(400, 800).alias("in_bounds"),
                                 F.round(F.min("threshold"), 6).alias("lowest"), F.max("threshold").alias("highest"))


@query("cost_curve", f"""WITH {COST} SELECT split, model, missed, flagged, round(cost, 2) AS cost_per_10k,
  round(min(threshold), 6) AS lowest_threshold FROM priced GROUP BY ALL""")
def _(spark, sf_dir):
    """Thresholds with equal counts are one plateau; each plateau is shown at its lowest threshold."""
    costs = K.cost_curve(shared_curve(spark, sf_dir), by=BY)
    return costs.groupBy(*BY, "missed", "flagged", F.round("cost", 2).alias("cost_per_10k")).agg(
        F.round(F.min("threshold"), 6).alias("lowest_threshold"))


@query("cost_at_threshold", f"""WITH {COST} SELECT split, model, round(threshold, 6) AS threshold,
  round(cost, 2) AS cost_per_10k FROM priced WHERE threshold >= {T_SQL}
  QUALIFY row_number() OVER (PARTITION BY split, model ORDER BY threshold) = 1""")
def _(spark, sf_dir):
    costs = K.cost_curve(shared_curve(spark, sf_dir), by=BY)
    return K.cost_at_threshold(costs, W.THRESHOLD, BY).select(*BY, *_six("threshold"), "cost_per_10k")


@query("cost_baselines", f"""WITH {TX} SELECT split, round(sum(label)*200e0/count(*)*10000e0, 2) AS flag_nothing_cost_per_10k,
  50000e0 AS flag_everything_cost_per_10k FROM tx GROUP BY split""")
def _(spark, sf_dir):
    return K.cost_baselines(W.transactions(spark, sf_dir), by=["split"])


@query("cost_threshold_select", f"""WITH {COST}, chosen AS (SELECT model, threshold FROM cheapest WHERE split = 'val'),
  hit AS (SELECT l.model, c.threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
    count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn
    FROM long l JOIN chosen c USING (model) WHERE split = 'test' GROUP BY 1, 2)
  SELECT model, round(threshold, 6) AS threshold, tp, fp, fn, tp+fp AS flagged,
    round(tp/CAST(tp+fp AS DOUBLE), 6) AS precision, round(tp/CAST(tp+fn AS DOUBLE), 6) AS recall FROM hit""")
def _(spark, sf_dir):
    """Threshold of least expected cost on validation, measured on test."""
    curve = shared_curve(spark, sf_dir)
    chosen = K.cheapest(K.cost_curve(curve.filter("split = 'val'"), by=BY), BY).select("model", "threshold")
    test = curve.filter("split = 'test'").join(chosen, "model")
    above = F.col("score") >= F.col("threshold")
    counts = test.groupBy("model", "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))
    return C.with_rates(counts).select("model", "tp", "fp", "fn", "flagged", *_six("threshold", "precision", "recall"))


@query("brier", f"""WITH {LONG} SELECT split, model, round(avg((score-label)*(score-label)), 6) AS brier
  FROM long GROUP BY split, model""")
def _(spark, sf_dir):
    return R.brier(_long(spark, sf_dir), by=BY).select(*BY, *_six("brier"))


@query("reliability_bins", f"""WITH {TX}, q AS (SELECT list_sort(list_distinct(quantile_cont(score_b,
    [CASE WHEN i=10 THEN 1e0 ELSE i*1e-1 END FOR i IN range(11)]))) AS e FROM tx),
  b AS (SELECT len(list_filter(e[2:len(e)-1], lambda x: x <= score_b)) AS bin, score_b, label FROM tx, q)
  SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score_b), 6) AS mean_pred,
    round(avg(label), 6) AS observed FROM b GROUP BY bin""")
def _(spark, sf_dir):
    bins = R.reliability_bins(W.scored(spark, sf_dir), "score_b")
    return bins.select("bin", "n", *_six("mean_pred", "observed"))


@query("full_report", f"WITH {REPORT} {report_select('b.split,', chr(10) + 'WHERE b.model = ' + chr(39) + 'score_b' + chr(39))}")
def _(spark, sf_dir):
    return R.full_report(W.scored(spark, sf_dir), "score_b", by=["split"])


@query("report_by_model", f"WITH {REPORT} {report_select()}")
def _(spark, sf_dir):
    return R.report_by_model(W.scored(spark, sf_dir), ["score_a", "score_b"], by=["split"])


@query("quantile_edges", """SELECT name, i AS idx, round(edge, 6) AS edge FROM (
  SELECT name, unnest(e) AS edge, unnest(range(len(e))) AS i FROM (
    SELECT name, list_sort(list_distinct(quantile_cont(v, [CASE WHEN k=10 THEN 1e0 ELSE k*1e-1 END FOR k IN range(11)]))) AS e
    FROM (SELECT 'l_extendedprice' AS name, l_extendedprice AS v FROM lineitem
          UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY name))""")
def _(spark, sf_dir):
    names = ["l_extendedprice", "l_discount"]
    found = N.column_quantiles(W.raw_lineitem(spark, sf_dir), names, X.even_grid(11))
    rows = [(n, i, edge) for n in names for i, edge in enumerate(sorted(set(found[n])))]
    return spark.createDataFrame(rows, "name string, idx long, edge double").select("name", "idx", *_six("edge"))


# -- data quality and drift

_CHECKS = f"""SELECT 'missing_columns' AS "check", 0e0 AS value, true AS ok
  UNION ALL SELECT 'null_features', CAST(count(*) FILTER ({" OR ".join(c + " IS NULL" for c in W.FEATURES)}) AS DOUBLE),
    count(*) FILTER ({" OR ".join(c + " IS NULL" for c in W.FEATURES)}) = 0 FROM tx
  UNION ALL SELECT 'binary_target', CAST(count(*) FILTER (label NOT IN (0, 1)) AS DOUBLE),
    count(*) FILTER (label NOT IN (0, 1)) = 0 FROM tx
  UNION ALL SELECT 'positive_rate', round(avg(label), 6), avg(label) BETWEEN 5e-4 AND 5e-2 FROM tx
  UNION ALL SELECT 'negative_amounts', CAST(count(*) FILTER (l_extendedprice < 0) AS DOUBLE),
    count(*) FILTER (l_extendedprice < 0) = 0 FROM tx"""


@query("validate_table", f"WITH {TX} {_CHECKS}")
def _(spark, sf_dir):
    return Q.require_valid(Q.validate_table(W.transactions(spark, sf_dir), W.FEATURES, "label", W.AMOUNT))


@query("missing_columns", """SELECT c AS name FROM (VALUES ('l_quantity'), ('l_tax'), ('V1'), ('Class')) v(c)
  WHERE c NOT IN (SELECT column_name FROM (DESCRIBE lineitem))""")
def _(spark, sf_dir):
    absent = Q.missing_columns(W.raw_lineitem(spark, sf_dir), ["l_quantity", "l_tax", "V1", "Class"])
    return spark.createDataFrame([(c,) for c in absent], "name string")


@query("label_domain", """SELECT CAST(v AS BIGINT) AS label, source FROM (
  SELECT DISTINCT quality AS v, 'labels' AS source FROM labels WHERE quality NOT IN (0, 1)
  UNION ALL SELECT DISTINCT label, 'embeddings' FROM embeddings WHERE label NOT IN (0, 1))""")
def _(spark, sf_dir):
    parts = []
    for table, column in (("labels", "quality"), ("embeddings", "label")):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column, F.lit(table).alias("source"))
        parts.append(Q.label_domain(df, column, ["source"]).select(F.col("label").cast("long"), "source"))
    return parts[0].unionByName(parts[1])


_HALVES = """SELECT CASE WHEN split <> 'test' THEN split WHEN seq < c2 + (n - c2)//2 THEN 'test_first_half'
    ELSE 'test_second_half' END AS win, """
_DRIFT_ONE = drift_ctes(W.FEATURES, f"SELECT CASE WHEN split='val' THEN 'test' ELSE split END AS win, {FEATURE_LIST} FROM tx")
_DRIFT_WINDOWS = drift_ctes([*W.FEATURES, "score"], _HALVES + f"{FEATURE_LIST}, score_b AS score FROM tx, cuts")


def _windows(spark, sf_dir):
    """Features and score of every row with its drift window."""
    scored = W.scored(spark, sf_dir)
    row = scored.filter("split = 'test'").agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("n")).first()
    half = F.when(F.col("seq") < row["low"] + row["n"] // 2, "test_first_half").otherwise("test_second_half")
    window = F.when(F.col("split") == "test", half).otherwise(F.col("split"))
    return scored.select(window.alias("win"), *W.FEATURES, F.col("score_b").alias("score"))


def _drift_report(spark, sf_dir):
    tx = W.transactions(spark, sf_dir)
    return D.feature_drift(tx.filter("split = 'train'"), tx.filter("split <> 'train'"), W.FEATURES)


@query("psi", f"WITH {TX}, {_DRIFT_ONE} SELECT feature, round(psi, 6) AS psi FROM drift WHERE feature = 'l_extendedprice'")
def _(spark, sf_dir):
    tx = W.transactions(spark, sf_dir)
    return D.psi(tx.filter("split = 'train'"), tx.filter("split <> 'train'"), "l_extendedprice").select("feature", *_six("psi"))


@query("feature_drift", f"WITH {TX}, {_DRIFT_ONE} SELECT feature, psi, status FROM labelled")
def _(spark, sf_dir):
    return _drift_report(spark, sf_dir)


@query("sort_reports", f"WITH {TX}, {_DRIFT_ONE} SELECT feature, psi FROM labelled ORDER BY psi DESC, feature")
def _(spark, sf_dir):
    return S.sort_report(_drift_report(spark, sf_dir), "psi", ["feature"]).select("feature", "psi")


@query("topk_features", f"""WITH {TX}, {_DRIFT_WINDOWS} SELECT win, feature, psi FROM labelled
  ORDER BY psi DESC, win, feature LIMIT 8""")
def _(spark, sf_dir):
    report = D.with_status(D.window_psi(_windows(spark, sf_dir), [*W.FEATURES, "score"], "win", "train"))
    return S.top_k(report, "psi", 8, ["win", "feature"]).select("win", "feature", "psi")


@query("window_drift", f"WITH {TX}, {_DRIFT_WINDOWS} SELECT win, feature, psi, status FROM labelled")
def _(spark, sf_dir):
    return D.with_status(D.window_psi(_windows(spark, sf_dir), [*W.FEATURES, "score"], "win", "train"))


@query("psi_label", f"WITH {TX}, {_DRIFT_WINDOWS} SELECT status, count(*) AS rows FROM labelled GROUP BY status")
def _(spark, sf_dir):
    report = D.window_psi(_windows(spark, sf_dir), [*W.FEATURES, "score"], "win", "train")
    return report.select(X.psi_label(F.round("psi", 4)).alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("rows"))


# Order totals against line prices drift apart by construction: one stable and one moved feature.
_MOVED = drift_ctes(["v"], """SELECT 'train' AS win, l_extendedprice AS v FROM lineitem
  UNION ALL SELECT 'orders', o_totalprice FROM orders UNION ALL SELECT 'self', l_extendedprice FROM lineitem""")


@query("drift_flagged", f"WITH {_MOVED} SELECT win, feature, psi, status FROM labelled WHERE status <> 'stable'")
def _(spark, sf_dir):
    line = W.raw_lineitem(spark, sf_dir).select(F.col("l_extendedprice").alias("v"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").alias("v"))
    tagged = (line.select(F.lit("train").alias("win"), "v").unionByName(orders.select(F.lit("orders").alias("win"), "v"))
              .unionByName(line.select(F.lit("self").alias("win"), "v")))
    return D.drift_flagged(D.with_status(D.window_psi(tagged, ["v"], "win", "train")))


@query("drift_summary", f"""WITH {TX}, {_DRIFT_WINDOWS} SELECT win, count(*) AS features, max(psi) AS max_psi,
  arg_max(feature, (psi, feature)) AS max_psi_feature, count(*) FILTER (status <> 'stable') AS moderate_or_worse
  FROM labelled GROUP BY win""")
def _(spark, sf_dir):
    report = D.with_status(D.window_psi(_windows(spark, sf_dir), [*W.FEATURES, "score"], "win", "train"))
    return D.drift_summary(report, ["win"])


@query("psi_reference", f"""WITH {TX}, v AS (SELECT score_b AS s FROM tx WHERE split = 'val'),
  q AS (SELECT list_sort(list_distinct(quantile_cont(s, [CASE WHEN i=10 THEN 1e0 ELSE i*1e-1 END FOR i IN range(11)]))) AS e FROM v),
  c AS (SELECT unnest(range(len(e)-1)) AS bin FROM q),
  b AS (SELECT len(list_filter(e[2:len(e)-1], lambda x: x <= s)) AS bin FROM v, q)
  SELECT bin, round(e[bin+1], 6) AS low, round(e[bin+2], 6) AS high,
    round((SELECT count(*) FROM b WHERE b.bin = c.bin)/CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS share FROM c, q""")
def _(spark, sf_dir):
    ref = D.psi_reference(W.scored(spark, sf_dir).filter("split = 'val'"), "score_b")
    return ref.select("edges", F.posexplode("reference").alias("bin", "share")).select(
        F.col("bin").cast("long").alias("bin"), F.round(F.get("edges", F.col("bin")), 6).alias("low"),
        F.round(F.get("edges", F.col("bin") + 1), 6).alias("high"), *_six("share"))


@query("join_ref_bins", f"""WITH {TX}, v AS (SELECT split, 'l_quantity' AS feature, l_quantity AS v FROM tx
    UNION ALL SELECT split, 'l_tax', l_tax FROM tx),
  q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [CASE WHEN i=10 THEN 1e0 ELSE i*1e-1 END FOR i IN range(11)]))) AS e
        FROM v WHERE split = 'train' GROUP BY feature)
  SELECT feature, CAST(len(list_filter(e[2:len(e)-1], lambda x: x <= v)) AS INTEGER) AS bin, count(*) AS rows
  FROM v JOIN q USING (feature) GROUP BY ALL""")
def _(spark, sf_dir):
    tx, names = W.transactions(spark, sf_dir), ["l_quantity", "l_tax"]
    edges = D.reference_edges(tx.filter("split = 'train'"), names)
    table = spark.createDataFrame([(c, e) for c, e in edges.items()], "feature string, edges array<double>")
    values = tx.select(*names).unpivot([], names, "feature", "value")
    return J.join_ref_bins(values, table, 10).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("rows"))


# -- registry and gate: one candidate per split, registered in time order

_VERSIONS = REPORT + """,
runs AS (SELECT model, split, round(pr_auc, 4) AS pr_auc,
           row_number() OVER (ORDER BY split, model) AS version FROM ranked)"""


def _runs(spark, sf_dir):
    """PR-AUC of both scores on every slice as registry candidates, created one day apart."""
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "train", 2).otherwise(4) \
        + F.when(F.col("model") == "score_b", 1).otherwise(0)
    return C.pr_auc(shared_curve(spark, sf_dir), BY).select(
        "model", F.col("split").alias("strategy"), F.lit(W.THRESHOLD).alias("threshold"),
        F.round("pr_auc", 4).alias("val_pr_auc"), F.round("pr_auc", 4).alias("test_pr_auc"),
        F.timestamp_seconds(F.lit(1704067200) + rank * 86400).alias("created_at"))


@query("registry_append", f"""WITH {_VERSIONS} SELECT version, model, split AS strategy, pr_auc AS test_pr_auc,
  replace(printf('%.4f', pr_auc), '.', '_') AS metric_label, version = max(version) OVER () AS is_default FROM runs""")
def _(spark, sf_dir):
    path = fresh_path(spark, "registry")
    runs = land(_runs(spark, sf_dir), "runs")
    Q.registry_append(path, runs.filter("strategy = 'test'"))
    return Q.registry_append(path, runs.filter("strategy <> 'test'")).select(
        "version", "model", "strategy", "test_pr_auc", "metric_label", "is_default")


@query("promotion_gate", f"""WITH {_VERSIONS}, champ AS (SELECT arg_max(pr_auc, version) AS champion FROM runs)
  SELECT model, split AS strategy, champion AS champion_pr_auc, pr_auc AS test_pr_auc,
    pr_auc >= CAST(0.2 AS DOUBLE) AND pr_auc >= champion - CAST(0.005 AS DOUBLE) AS passed FROM runs, champ""")
def _(spark, sf_dir):
    registry = Q.next_version(spark.createDataFrame([], Q.REGISTRY_SCHEMA), _runs(spark, sf_dir))
    best = Q.champion(registry).first()["champion_pr_auc"]
    return registry.select("model", "strategy", F.lit(best).alias("champion_pr_auc"), "test_pr_auc",
                           Q.gate_expr(F.col("test_pr_auc"), F.lit(best), 0.2).alias("passed"))


@query("model_select", f"""WITH {REPORT} SELECT split, model, round(pr_auc, 4) AS val_pr_auc FROM ranked
  QUALIFY row_number() OVER (PARTITION BY split ORDER BY round(pr_auc, 4) DESC, model) = 1""")
def _(spark, sf_dir):
    runs = C.pr_auc(shared_curve(spark, sf_dir), BY).select(
        *BY, F.round("pr_auc", 4).alias("val_pr_auc"), F.when(F.col("model") == "score_a", 0).otherwise(1).alias("run_idx"))
    return P.model_select(runs, by=["split"]).select("split", "model", "val_pr_auc")


@query("seed_stability", f"""WITH {REPORT} SELECT model, count(*) AS seeds, round(avg(round(pr_auc, 4)), 4) AS mean,
  round(stddev_pop(round(pr_auc, 4)), 4) AS std FROM ranked GROUP BY model""")
def _(spark, sf_dir):
    """Spread of the metric over repeated measurements; each slice stands for one run."""
    runs = C.pr_auc(shared_curve(spark, sf_dir), BY).withColumn("pr_auc", F.round("pr_auc", 4))
    return P.seed_stability(runs, "pr_auc", ["model"])


# -- event tables

_SCORED_EV = EV + """,
sc AS (SELECT *, produced + to_milliseconds(CAST(floor(value*10) AS BIGINT)) AS scored FROM ev)"""


def scored_events(spark, sf_dir):
    """Events with a batch score and a scoring stamp that follows from the row."""
    ev = W.events(spark, sf_dir).withColumn("produced_at", F.date_trunc("millisecond", "ts"))
    later = F.timestamp_micros(F.unix_micros("produced_at") + F.floor(F.col("value") * 10) * 1000)
    return ev.withColumn("scored_at", later).withColumn("is_alert", F.col("score") >= W.EVENT_THRESHOLD)


@query("event_encode", f"""WITH {EV} SELECT CAST(event_id AS VARCHAR) AS key, event_id, label,
  round(value, 6) AS feature, {iso('produced')} AS produced_at FROM ev""")
def _(spark, sf_dir):
    from tallyrisk.streaming.windows import event_encode

    lines = event_encode(W.events(spark, sf_dir), ["value"], "event_id", F.col("ts"), "label")
    return lines.select("key", E.parsed(F.col("value")).alias("e")).select(
        "key", "e.event_id", "e.label", F.col("e.features")[0].alias("feature"), "e.produced_at")


@query("parse_events", f"""WITH {EV} SELECT 'valid' AS part, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ev
  WHERE event_id % 7 <> 0 UNION ALL SELECT 'rejected', count(*), CAST(sum(event_id) AS BIGINT) FROM ev WHERE event_id % 7 = 0""")
def _(spark, sf_dir):
    """Every seventh line arrives damaged (cut off, or without a field) and must land in the dead letters."""
    from tallyrisk.streaming.windows import event_encode

    lines = event_encode(W.events(spark, sf_dir), ["value"], "event_id", F.col("ts"), "label")
    number = F.col("key").cast("long")
    cut = F.concat(F.substring("value", 1, 20), F.col("key"))
    blank = F.regexp_replace("value", '"label":', '"tag":')
    value = F.when(number % 14 == 0, cut).when(number % 7 == 0, blank).otherwise(F.col("value"))
    sent = lines.select(value.alias("value"))
    valid = E.parse_events(sent, 1).agg(F.lit("valid").alias("part"), F.count(F.lit(1)).alias("lines"),
                                        F.sum("event_id").alias("id_sum"))
    # A cut line keeps its 20 characters and then the id; a blanked one still holds the id in its text.
    from_cut = F.substring("value", 21, 20)
    from_blank = F.regexp_extract("value", '"event_id":(\\d+)', 1)
    key = F.when(F.col("value").contains('"tag":'), from_blank).otherwise(from_cut)
    rejected = E.dead_letters(sent, 1).agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("lines"),
                                           F.sum(key.cast("long")).alias("id_sum"))
    return valid.unionByName(rejected)


@query("join_scores_by_id", f"""WITH {EV} SELECT event_id, label, round(score, 6) AS streamed, round(score, 6) AS local
  FROM ev UNION ALL SELECT event_id, label, round(score, 6), round(score, 6) FROM ev WHERE label = 1""")
def _(spark, sf_dir):
    ev = W.events(spark, sf_dir)
    streamed = ev.select("event_id", F.col("score").alias("streamed"))
    again = ev.filter("label = 1").select("event_id", F.col("score").alias("streamed"))
    return J.join_scores_by_id(streamed.unionByName(again), ev.select("event_id", "label", F.col("score").alias("local"))) \
        .select("event_id", "label", *_six("streamed", "local"))


@query("missing_after_stream", f"WITH {EV} SELECT event_id, label FROM ev WHERE is_alert")
def _(spark, sf_dir):
    ev = scored_events(spark, sf_dir)
    return J.missing_after_stream(ev.select("event_id", "label"), ev.filter(~F.col("is_alert")))


@query("duplicate_count", """SELECT count(*) AS rows, count(DISTINCT user_id) AS ids,
  count(*) - count(DISTINCT user_id) AS duplicates FROM events""")
def _(spark, sf_dir):
    return J.duplicate_count(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")


@query("score_agreement", f"""WITH {EV} SELECT count(*) AS rows,
  round(max(abs(round(value, 1)/(round(value, 1)+100e0) - score)), 6) AS max_abs_score_diff,
  bool_and((round(value, 1)/(round(value, 1)+100e0) >= CAST({W.EVENT_THRESHOLD} AS DOUBLE)) = is_alert) AS alerts_identical FROM ev""")
def _(spark, sf_dir):
    ev = W.events(spark, sf_dir)
    remote = ev.select("event_id", W.event_score(F.round("value", 1)).alias("score"))
    remote = remote.withColumn("is_alert", F.col("score") >= W.EVENT_THRESHOLD)
    found = J.score_agreement(remote, ev.select("event_id", "score"), W.EVENT_THRESHOLD)
    return found.select("rows", *_six("max_abs_score_diff"), "alerts_identical")


@query("latency_percentiles", f"""WITH {_SCORED_EV}, m AS (SELECT CAST(epoch_ms(scored) - epoch_ms(produced) AS DOUBLE) AS ms FROM sc)
  SELECT 'scored_at' AS stamp, round(quantile_cont(ms, 0.5e0), 1) AS p50_ms, round(quantile_cont(ms, 95e-2), 1) AS p95_ms,
    round(quantile_cont(ms, 99e-2), 1) AS p99_ms, round(max(ms), 1) AS max_ms FROM m""")
def _(spark, sf_dir):
    return P.latency_percentiles(scored_events(spark, sf_dir))


@query("latency_budget", f"""WITH {_SCORED_EV}, m AS (SELECT CAST(epoch_ms(scored) - epoch_ms(produced) AS DOUBLE) AS ms FROM sc)
  SELECT b AS budget_ms, quantile_cont(ms, 95e-2) <= b AS meets_budget FROM m, (VALUES (10e0), (1000e0), (4000e0)) v(b) GROUP BY b""")
def _(spark, sf_dir):
    found = P.latency_percentiles(scored_events(spark, sf_dir))
    parts = [P.latency_budget(found, b).select(F.lit(b).alias("budget_ms"), "meets_budget") for b in (10.0, 1000.0, 4000.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("throughput", f"""WITH {_SCORED_EV}, t AS (SELECT count(*) AS events,
    (epoch_ms(max(scored)) - epoch_ms(min(produced)))/1000e0 AS seconds FROM sc)
  SELECT events, seconds, round(events/seconds, 1) AS events_per_second FROM t""")
def _(spark, sf_dir):
    return P.throughput(scored_events(spark, sf_dir))


@query("stream_alert_report", f"""WITH {EV}, c AS (SELECT date_trunc('day', produced) AS day, count(*) FILTER (is_alert) AS alerts,
    count(*) FILTER (is_alert AND label=1) AS tp, count(*) FILTER (is_alert AND label=0) AS fp,
    count(*) FILTER (NOT is_alert AND label=1) AS fn FROM ev GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, alerts, tp, fp, fn, round(tp/greatest(1, tp+fp), 4) AS precision,
    round(tp/greatest(1, tp+fn), 4) AS recall FROM c""")
def _(spark, sf_dir):
    days = scored_events(spark, sf_dir).withColumn("day", F.date_format("produced_at", "yyyy-MM-dd"))
    return P.stream_alert_report(days, by=["day"])


@query("visible_lag", f"""WITH {_SCORED_EV}, b AS (SELECT date_trunc('hour', produced) AS h, count(*) AS n,
    max(produced) AS newest, max(scored) AS seen FROM sc GROUP BY 1)
  SELECT {iso('h')} AS sampled_at, CAST(sum(n) OVER w AS BIGINT) AS scored,
    round((epoch_ms(seen) - epoch_ms(max(newest) OVER w))/1000e0, 1) AS visible_lag_s FROM b WINDOW w AS (ORDER BY h)""")
def _(spark, sf_dir):
    """Hourly batches stand in for micro-batches."""
    ev = scored_events(spark, sf_dir).withColumn("batch", F.date_trunc("hour", "produced_at"))
    return P.visible_lag(ev, "batch", written="scored_at").withColumn("sampled_at", X.iso_millis(F.col("sampled_at")))


@query("cost_estimate", """SELECT l_linestatus AS resource, round(sum(l_quantity*l_tax), 4) AS total
  FROM lineitem GROUP BY l_linestatus""")
def _(spark, sf_dir):
    """Quantity times unit price, with line items as the usage table."""
    usage = W.raw_lineitem(spark, sf_dir).select(
        F.col("l_linestatus").alias("resource"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("unit_price"))
    return P.cost_estimate(usage, by=["resource"])


@query("scalar_projection", f"""SELECT event_id, {iso("date_trunc('millisecond', ts)")} AS iso_text,
    {iso("date_trunc('minute', ts)")} AS minute, round(1e0/(1e0+exp(-(value-100e0)/50e0)), 6) AS squashed,
    round(ln(greatest(value, 1e0)), 6) AS log_clipped, round(abs(value-100e0), 4) AS distance,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS k, 0e0 AS absent,
    replace(printf('%.4f', value/100e0), '.', '_') AS label_text, round((value-100e0)/50e0, 6) AS standard,
    CAST(event_type = 'click' AS INTEGER) AS is_click, epoch_ms(date_trunc('millisecond', ts)) - epoch_ms(date_trunc('minute', ts)) AS ms_in_minute
  FROM events""")
def _(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    props = F.from_json("props", "map<string,double>")
    iso_text = X.iso_millis(F.col("ts"))
    minute = F.date_trunc("minute", "ts")
    return ev.select(
        "event_id", iso_text.alias("iso_text"), X.iso_millis(minute).alias("minute"),
        F.round(X.sigmoid((F.col("value") - 100.0) / 50.0), 6).alias("squashed"),
        F.round(F.ln(F.greatest("value", F.lit(1.0))), 6).alias("log_clipped"),
        F.round(F.abs(F.col("value") - 100.0), 4).alias("distance"),
        X.map_value(props, "k").alias("k"), X.map_value(props, "absent").alias("absent"),
        X.encode_label_text(F.col("value") / 100.0).alias("label_text"),
        F.round(X.standardise(F.col("value"), 100.0, 50.0), 6).alias("standard"),
        (F.col("event_type") == "click").cast("int").alias("is_click"),
        X.millis_between(X.parse_iso(iso_text), minute).alias("ms_in_minute"))


@query("sink_row_count", "SELECT count(*) AS rows FROM orders")
def _(spark, sf_dir):
    path = fresh_path(spark, "orders")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(path)
    return sinks.sink_row_count(spark, path)
