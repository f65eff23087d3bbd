"""Common table expressions of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from tallyrisk.plans.workload import EVENT_THRESHOLD, FEATURES, TIME_ORDER

_LOGIT = "1e-1*l_quantity + 40e0*l_discount - 8e0"


def _score(logit: str) -> str:
    return f"floor((1e0/(1e0+exp(-({logit}))))*1e9 + 0.5e0)/1e9"


TX = f"""
base AS (SELECT row_number() OVER (ORDER BY {", ".join(TIME_ORDER)}) - 1 AS seq, {", ".join(FEATURES)},
           CAST(l_returnflag = 'R' AND l_discount >= CAST(0.09 AS DOUBLE) AND l_quantity >= 45 AS INTEGER) AS label
         FROM lineitem),
cuts AS (SELECT count(*) AS n, CAST(floor(count(*)*CAST(0.7 AS DOUBLE)) AS BIGINT) AS c1,
           CAST(floor(count(*)*(CAST(0.7 AS DOUBLE)+CAST(0.1 AS DOUBLE))) AS BIGINT) AS c2 FROM lineitem),
tx AS (SELECT b.*, CASE WHEN seq < c1 THEN 'train' WHEN seq < c2 THEN 'val' ELSE 'test' END AS split,
         {_score(_LOGIT)} AS score_a, {_score(_LOGIT + " + l_extendedprice*1e-5")} AS score_b
       FROM base b, cuts)"""

LONG = TX + """,
long AS (SELECT seq, split, label, 'score_a' AS model, score_a AS score FROM tx
         UNION ALL SELECT seq, split, label, 'score_b', score_b FROM tx)"""

CURVE = LONG + """,
tied AS (SELECT split, model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*)-sum(label) AS BIGINT) AS neg
         FROM long GROUP BY split, model, score),
curve AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
            CAST(sum(pos) OVER g AS BIGINT) AS positives, CAST(sum(neg) OVER g AS BIGINT) AS negatives,
            row_number() OVER w - 1 AS idx, count(*) OVER g AS points,
            lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
          FROM tied WINDOW w AS (PARTITION BY split, model ORDER BY score DESC), g AS (PARTITION BY split, model)),
prf AS (SELECT *, tp/CAST(tp+fp AS DOUBLE) AS p, CASE WHEN positives=0 THEN 0 ELSE tp/CAST(positives AS DOUBLE) END AS r
        FROM curve),
f1s AS (SELECT *, 2e0*p*r/greatest(p+r, 1e-12) AS f1 FROM prf),
best_f1 AS (SELECT split, model, score AS threshold, f1, tp, fp, positives FROM f1s
            QUALIFY row_number() OVER (PARTITION BY split, model ORDER BY f1 DESC, score) = 1)"""

COST = CURVE + """,
grid_i AS (SELECT unnest(range(400)) AS i),
thresholds AS (
  SELECT DISTINCT split, model, threshold FROM (
    SELECT split, model, unnest(quantile_cont(score, [CASE WHEN i=399 THEN 1e0 ELSE i*(1e0/399e0) END
                                                      FOR i IN range(400)])) AS threshold
    FROM long GROUP BY split, model
    UNION ALL
    SELECT g.split, g.model, CASE WHEN i=399 THEN 1e0 ELSE pow(10e0, -6e0 + i*(6e0/399e0)) END
    FROM (SELECT DISTINCT split, model FROM tied) g, grid_i)),
costs AS (
  SELECT t.split, t.model, t.threshold,
    CAST(coalesce(sum(CASE WHEN c.score < t.threshold THEN c.pos END), 0) AS BIGINT) AS missed,
    CAST(coalesce(sum(CASE WHEN c.score >= t.threshold THEN c.pos + c.neg END), 0) AS BIGINT) AS flagged,
    CAST(sum(c.pos + c.neg) AS BIGINT) AS n
  FROM thresholds t JOIN tied c ON c.split = t.split AND c.model = t.model GROUP BY 1, 2, 3),
priced AS (SELECT *, (missed*200e0 + flagged*5e0)/n*10000e0 AS cost FROM costs),
cheapest AS (SELECT split, model, threshold, round(cost, 2) AS cost_per_10k, missed, flagged FROM priced
             QUALIFY row_number() OVER (PARTITION BY split, model ORDER BY cost, threshold) = 1)"""

REPORT = COST + """,
ranked AS (
  SELECT split, model,
    sum(CASE WHEN pos > 0 THEN pos/CAST(positives AS DOUBLE)*p ELSE 0 END) AS pr_auc,
    sum(neg*(tp - pos/2e0))/max(CAST(positives AS DOUBLE)*negatives) AS roc_auc,
    coalesce(max(CASE WHEN fp/CAST(negatives AS DOUBLE) <= 1e-3 THEN r END), 0) AS r01,
    coalesce(max(CASE WHEN fp/CAST(negatives AS DOUBLE) <= 1e-2 THEN r END), 0) AS r1
  FROM prf GROUP BY split, model)"""


def report_select(extra: str = "b.split, b.model,", where: str = "") -> str:
    """The 16-value report at the best-F1 threshold."""
    return f"""
SELECT {extra} round(r.pr_auc, 4) AS pr_auc, round(r.roc_auc, 4) AS roc_auc,
  round(r.r01, 4) AS recall_at_fpr_0_1pct, round(r.r1, 4) AS recall_at_fpr_1pct,
  round(b.threshold, 4) AS threshold, round(b.tp/CAST(b.tp+b.fp AS DOUBLE), 4) AS precision,
  round(b.tp/CAST(b.positives AS DOUBLE), 4) AS recall,
  round(2e0*b.tp/(b.tp+b.fp+b.positives), 4) AS f1, b.tp+b.fp AS flagged, b.tp, b.fp, b.positives-b.tp AS fn,
  round(c.threshold, 6) AS cost_threshold, c.cost_per_10k, c.missed AS cost_missed, c.flagged AS cost_flagged
FROM best_f1 b JOIN ranked r USING (split, model) JOIN cheapest c USING (split, model) {where}"""


EV = f"""
ev AS (SELECT event_id, ts, date_trunc('millisecond', ts) AS produced, value, CAST(value >= 200 AS INTEGER) AS label,
         value/(value+100e0) AS score, value/(value+100e0) >= CAST({EVENT_THRESHOLD} AS DOUBLE) AS is_alert FROM events)"""


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def drift_ctes(columns: list[str], windows: str) -> str:
    """`drift` (win, feature, psi) over `tagged` = SELECT win, <columns>; reference window 'train'."""
    values = " UNION ALL ".join(f"SELECT win, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM tagged" for c in columns)
    return f"""
tagged AS ({windows}),
vals AS ({values}),
qs AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [CASE WHEN i=10 THEN 1e0 ELSE i*1e-1 END
         FOR i IN range(11)]))) AS e FROM vals WHERE win = 'train' GROUP BY feature),
binned AS (SELECT win, feature, len(list_filter(e[2:len(e)-1], lambda x: x <= v)) AS bin, greatest(len(e)-1, 1) AS bins
           FROM vals JOIN qs USING (feature)),
held AS (SELECT win, feature, bin, count(*) AS n FROM binned GROUP BY 1, 2, 3),
sizes AS (SELECT win, feature, count(*) AS total FROM vals GROUP BY 1, 2),
cells AS (SELECT feature, unnest(range(greatest(len(e)-1, 1))) AS bin FROM qs),
shares AS (SELECT s.win, c.feature, c.bin, greatest(coalesce(h.n, 0)/CAST(s.total AS DOUBLE), 1e-4) AS share
           FROM cells c JOIN sizes s USING (feature)
           LEFT JOIN held h ON h.win = s.win AND h.feature = c.feature AND h.bin = c.bin),
drift AS (SELECT x.win, x.feature, sum((x.share - r.share)*ln(x.share/r.share)) AS psi
          FROM shares x JOIN shares r ON r.feature = x.feature AND r.bin = x.bin AND r.win = 'train'
          WHERE x.win <> 'train' GROUP BY 1, 2),
labelled AS (SELECT win, feature, round(psi, 4) AS psi, CASE WHEN round(psi, 4) < 0.1 THEN 'stable'
               WHEN round(psi, 4) < 0.25 THEN 'moderate' ELSE 'significant' END AS status FROM drift)"""
