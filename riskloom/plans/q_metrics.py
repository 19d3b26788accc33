"""Registered queries: scored-population metrics (2.9) and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.exprs import linspace
from riskloom.operators import metrics as M
from riskloom.operators.quality import quality_gate
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import with_scored
from riskloom.sources.encounters import scored


def _sc(spark, sf_dir):
    return scored(spark, sf_dir, with_groups=False).cache()


def _values(vals, name="t"):
    return "(VALUES " + ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(vals)) + f") {name}(j, t)"


# ---- AUC / AP / curves -----------------------------------------------------------
@query("auc_roc")
def q_auc(spark, sf_dir):
    return M.auc_roc(_sc(spark, sf_dir))


# rank-sum form (independent of the cumulative form used on Spark)
_AUC_SQL = """(SELECT (sum(CASE WHEN label = 1 THEN mr END) - p * (p + 1) / 2.0) / (p * (cnt - p)) AS auc
  FROM (SELECT label, avg(rn) OVER (PARTITION BY score) AS mr, sum(label) OVER () AS p,
               count(*) OVER () AS cnt
        FROM (SELECT label, score, row_number() OVER (ORDER BY score, encounter_id) AS rn FROM scored) r) m
  GROUP BY p, cnt)"""
oracle("auc_roc", with_scored(f"SELECT round(auc, 6) AS auc_roc FROM {_AUC_SQL} a"))


@query("gini")
def q_gini(spark, sf_dir):
    return M.auc_roc(_sc(spark, sf_dir)).select(F.round(2 * F.col("auc_roc") - 1, 6).alias("gini"))


oracle("gini", with_scored(f"SELECT round(2 * round(auc, 6) - 1, 6) AS gini FROM {_AUC_SQL} a"))

_DESC = """d AS (SELECT score, count(*) AS n, sum(label) AS pos, count(*) - sum(label) AS neg
               FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
             row_number() OVER (ORDER BY score DESC) AS idx,
             sum(pos) OVER () AS p, sum(neg) OVER () AS nn, sum(n) OVER () AS total FROM d)"""


@query("average_precision")
def q_ap(spark, sf_dir):
    return M.average_precision(_sc(spark, sf_dir))


oracle("average_precision", with_scored(
    "SELECT round(sum(pos * tps / (tps + fps)) / max(p), 6) AS average_precision FROM c", _DESC))


@query("roc_curve")
def q_roc(spark, sf_dir):
    return M.roc_curve(_sc(spark, sf_dir))


oracle("roc_curve", with_scored(
    "SELECT 'inf'::DOUBLE AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr UNION ALL "
    "SELECT score, round(fps / nn, 6), round(tps / p, 6) FROM ("
    "SELECT *, lag(fps) OVER (ORDER BY idx) AS fp_prev, lead(fps) OVER (ORDER BY idx) AS fp_next, "
    "lag(tps) OVER (ORDER BY idx) AS tp_prev, lead(tps) OVER (ORDER BY idx) AS tp_next FROM c) x "
    "WHERE tp_prev IS NULL OR tp_next IS NULL OR fp_prev - 2 * fps + fp_next <> 0 "
    "OR tp_prev - 2 * tps + tp_next <> 0", _DESC))


@query("pr_curve")
def q_pr(spark, sf_dir):
    return M.pr_curve(_sc(spark, sf_dir))


oracle("pr_curve", with_scored(
    "SELECT score AS threshold, round(tps / (tps + fps), 6) AS precision, round(tps / p, 6) AS recall, "
    "round(p / total, 6) AS base_rate FROM c WHERE idx <= (SELECT min(idx) FROM c WHERE tps = p) "
    "UNION ALL SELECT NULL, 1.0, 0.0, round(max(p) / max(total), 6) FROM c", _DESC))


# ---- probabilistic -----------------------------------------------------------------
@query("brier")
def q_brier(spark, sf_dir):
    return M.brier_logloss(_sc(spark, sf_dir)).select("brier")


oracle("brier", with_scored("SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM scored"))


@query("log_loss")
def q_logloss(spark, sf_dir):
    return M.brier_logloss(_sc(spark, sf_dir)).select("log_loss")


oracle("log_loss", with_scored(
    f"SELECT round(-avg(label * ln(pc) + (1 - label) * ln(1 - pc)), 6) AS log_loss FROM "
    f"(SELECT label, least(greatest(score, {M.EPS64!r}), {1 - M.EPS64!r}) AS pc FROM scored) x"))


@query("ks_stat")
def q_ks(spark, sf_dir):
    return M.ks_stat(_sc(spark, sf_dir))


oracle("ks_stat", with_scored(
    "SELECT round(max(abs(tpr - fpr)), 6) AS ks_statistic FROM (SELECT t, "
    "count_if(label = 1 AND score >= t) / sum(label) AS tpr, "
    "count_if(label = 0 AND score >= t) / sum(1 - label) AS fpr "
    f"FROM scored CROSS JOIN {_values(linspace(0.0, 1.0, C.KS_THRESHOLDS))} GROUP BY t) k"))

_EDGES = linspace(0.0, 1.0, C.CALIBRATION_BINS + 1)
_BIN_SQL = "CASE " + " ".join(
    f"WHEN score >= {_EDGES[i]!r} AND score < {_EDGES[i + 1]!r} THEN {i}"
    for i in range(len(_EDGES) - 1)) + " END"
_CAL = f"""bins AS (SELECT {_BIN_SQL} AS bin, count(*) AS n, avg(label) AS acc, avg(score) AS conf,
                  sum(count(*)) OVER () AS total FROM scored GROUP BY 1)"""


@query("ece")
def q_ece(spark, sf_dir):
    return M.ece_mce(_sc(spark, sf_dir)).select("ece")


oracle("ece", with_scored(
    "SELECT round(coalesce(sum(n / total * abs(acc - conf)), 0), 6) AS ece FROM bins WHERE bin IS NOT NULL",
    _CAL))


@query("mce")
def q_mce(spark, sf_dir):
    return M.ece_mce(_sc(spark, sf_dir)).select("mce")


oracle("mce", with_scored(
    "SELECT round(coalesce(max(abs(acc - conf)), 0), 6) AS mce FROM bins WHERE bin IS NOT NULL", _CAL))


@query("reliability_table")
def q_reliability(spark, sf_dir):
    return M.reliability_table(_sc(spark, sf_dir))


_INNER = linspace(0.0, 1.0, C.CALIBRATION_BINS + 1)[1:-1]
oracle("reliability_table", with_scored(
    "SELECT bin, count(*) AS n, round(avg(label), 6) AS prob_true, round(avg(score), 6) AS prob_pred "
    "FROM (SELECT *, " + " + ".join(f"CASE WHEN score > {e!r} THEN 1 ELSE 0 END" for e in _INNER)
    + " AS bin FROM scored) b GROUP BY bin"))


@query("score_histogram")
def q_hist(spark, sf_dir):
    return M.score_histogram(_sc(spark, sf_dir))


def _hist_sql():
    # edges per class depend on data; the oracle recomputes them with the same
    # linspace rule (lo + i·(hi−lo)/40) and counts the inner edges ≤ score.
    inner = " + ".join(
        f"CASE WHEN score >= lo + {i} * ((hi - lo) / 40.0) THEN 1 ELSE 0 END" for i in range(1, 40))
    return ("SELECT label, least(" + inner + ", 39) AS bin, count(*) AS count FROM scored "
            "JOIN (SELECT label, min(score) AS lo, max(score) AS hi FROM scored GROUP BY label) r "
            "USING (label) GROUP BY 1, 2")


oracle("score_histogram", with_scored(_hist_sql()))


# ---- threshold grid -----------------------------------------------------------------
@query("threshold_sweep")
def q_sweep(spark, sf_dir):
    return M.threshold_sweep(_sc(spark, sf_dir))


_SWEEP = f"""sw AS (
  SELECT t, count_if(score >= t AND label = 1) AS tp, count_if(score >= t AND label = 0) AS fp,
         count_if(score < t AND label = 1) AS fn, count_if(score >= t) AS flagged, count(*) AS total,
         sum(label) AS p
  FROM scored CROSS JOIN {_values(linspace(0.01, 0.99, C.SWEEP_POINTS))} GROUP BY t),
sweep AS (
  SELECT round(t, 6) AS threshold, round(tp / flagged, 6) AS precision,
         round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS recall,
         round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
         round(flagged / total, 6) AS flagged_pct
  FROM sw WHERE flagged > 0)"""
oracle("threshold_sweep", with_scored("SELECT * FROM sweep", _SWEEP))


@query("best_f1")
def q_best_f1(spark, sf_dir):
    return M.best_f1(_sc(spark, sf_dir))


oracle("best_f1", with_scored(
    "SELECT f1 AS best_f1, threshold AS best_f1_threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    _SWEEP))


@query("confusion_matrix")
def q_cm(spark, sf_dir):
    return M.confusion_matrix(_sc(spark, sf_dir), 0.5)


oracle("confusion_matrix", with_scored(
    "SELECT count_if(label = 0 AND score < 0.5) AS tn, count_if(label = 0 AND score >= 0.5) AS fp, "
    "count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp FROM scored"))


@query("predict_class")
def q_predict_class(spark, sf_dir):
    return M.predict_class(_sc(spark, sf_dir)).select("encounter_id", "pred")


oracle("predict_class", with_scored(
    "SELECT encounter_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored"))

_CU = """cu AS (
  SELECT thr, count_if(label = 1 AND score >= thr) AS tp, count_if(label = 0 AND score >= thr) AS fp,
         count_if(label = 0 AND score < thr) AS tn, count_if(label = 1 AND score < thr) AS fn
  FROM scored CROSS JOIN (SELECT quantile_cont(score, 0.8) AS thr FROM scored) q GROUP BY thr)"""


@query("clinical_utility")
def q_cu(spark, sf_dir):
    return M.clinical_utility(_sc(spark, sf_dir)).drop("est_savings_usd")


_PPV = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
oracle("clinical_utility", with_scored(
    f"SELECT round(thr, 6) AS threshold, 0.2::DOUBLE AS flag_pct, round({_PPV}, 6) AS ppv, "
    "round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS sensitivity, "
    "round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity, "
    f"round(CASE WHEN {_PPV} > 0 THEN 1 / ({_PPV}) ELSE 'inf'::DOUBLE END, 6) AS nnt, "
    "tp, fp, tn, fn FROM cu", _CU))


@query("est_savings")
def q_savings(spark, sf_dir):
    return M.clinical_utility(_sc(spark, sf_dir)).select("tp", "est_savings_usd")


oracle("est_savings", with_scored(
    f"SELECT tp, cast(tp * {C.INTERVENTION_EFFICACY} * {C.READMISSION_COST} AS DOUBLE) AS est_savings_usd FROM cu",
    _CU))


@query("classification_report")
def q_cr(spark, sf_dir):
    return M.classification_report(_sc(spark, sf_dir), 0.5)


def _cr_sql():
    def prf(tp, fp, fn):
        return (f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END",
                f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END",
                f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END")
    p1, r1, f1 = prf("tp", "fp", "fn")
    p0, r0, f0 = prf("tn", "fn", "fp")
    rows = [("0", p0, r0, f0, "tn + fp"), ("1", p1, r1, f1, "tp + fn"),
            ("macro avg", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2",
             "tn + fp + tp + fn"),
            ("weighted avg", f"(({p0}) * (tn + fp) + ({p1}) * (tp + fn)) / (tn + fp + tp + fn)",
             f"(({r0}) * (tn + fp) + ({r1}) * (tp + fn)) / (tn + fp + tp + fn)",
             f"(({f0}) * (tn + fp) + ({f1}) * (tp + fn)) / (tn + fp + tp + fn)", "tn + fp + tp + fn")]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round({f}, 6) AS f1, {s} AS support FROM cm" for k, p, r, f, s in rows)


oracle("classification_report", with_scored(_cr_sql(),
    "cm AS (SELECT count_if(label = 0 AND score < 0.5) AS tn, count_if(label = 0 AND score >= 0.5) AS fp, "
    "count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 1 AND score >= 0.5) AS tp FROM scored)"))


@query("score_deciles")
def q_deciles(spark, sf_dir):
    return M.score_deciles(_sc(spark, sf_dir))


_PROBS = "[" + ", ".join(repr(p) for p in linspace(0.0, 1.0, 11)) + "]"
oracle("score_deciles", with_scored(
    "SELECT greatest(len(list_filter(e, lambda x: x < score)) - 1, 0) AS decile, count(*) AS n, "
    "round(avg(label), 6) AS readmission_rate, round(avg(score), 6) AS mean_score "
    f"FROM scored CROSS JOIN (SELECT list_distinct(quantile_cont(score, {_PROBS})) AS e FROM scored) q "
    "GROUP BY 1"))


@query("metrics_report")
def q_metrics_report(spark, sf_dir):
    return M.headline_metrics(_sc(spark, sf_dir))


@query("quality_gate")
def q_quality_gate(spark, sf_dir):
    return quality_gate(spark, M.gate_metrics(_sc(spark, sf_dir)))


_REPORT_SQL = f"""
SELECT 'auc_roc' AS metric, round(auc, 6) AS value FROM {_AUC_SQL} a
UNION ALL SELECT 'gini', round(2 * round(auc, 6) - 1, 6) FROM {_AUC_SQL} a
UNION ALL SELECT 'average_precision', round(sum(pos * tps / (tps + fps)) / max(p), 6) FROM c
UNION ALL SELECT 'brier', round(avg((score - label) * (score - label)), 6) FROM scored
UNION ALL SELECT 'log_loss', round(-avg(label * ln(least(greatest(score, {M.EPS64!r}), {1 - M.EPS64!r}))
      + (1 - label) * ln(1 - least(greatest(score, {M.EPS64!r}), {1 - M.EPS64!r}))), 6) FROM scored
UNION ALL SELECT 'ks_statistic', round(max(abs(tpr - fpr)), 6) FROM (SELECT t,
      count_if(label = 1 AND score >= t) / sum(label) AS tpr,
      count_if(label = 0 AND score >= t) / sum(1 - label) AS fpr
      FROM scored CROSS JOIN {_values(linspace(0.0, 1.0, C.KS_THRESHOLDS))} GROUP BY t) k
UNION ALL SELECT 'ece', round(coalesce(sum(n / total * abs(acc - conf)), 0), 6) FROM bins WHERE bin IS NOT NULL
UNION ALL SELECT 'mce', round(coalesce(max(abs(acc - conf)), 0), 6) FROM bins WHERE bin IS NOT NULL
UNION ALL (SELECT 'best_f1', f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL (SELECT 'best_f1_threshold', threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'ppv', round({_PPV}, 6) FROM cu
UNION ALL SELECT 'npv', round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) FROM cu
UNION ALL SELECT 'sensitivity', round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) FROM cu
UNION ALL SELECT 'specificity', round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) FROM cu
UNION ALL SELECT 'nnt', round(CASE WHEN {_PPV} > 0 THEN 1 / ({_PPV}) ELSE 'inf'::DOUBLE END, 6) FROM cu
UNION ALL SELECT 'clinical_threshold', round(thr, 6) FROM cu
UNION ALL SELECT 'est_savings_usd', cast(tp * {C.INTERVENTION_EFFICACY} * {C.READMISSION_COST} AS DOUBLE) FROM cu"""
_REPORT_CTES = f"{_DESC},\n{_CAL},\n{_SWEEP},\n{_CU}"
oracle("metrics_report", with_scored(_REPORT_SQL, _REPORT_CTES))
oracle("quality_gate", with_scored(
    f"""SELECT g.metric, r.value, g.op, g.bound,
        coalesce(CASE WHEN g.op = '>=' THEN r.value >= g.bound ELSE r.value <= g.bound END, false) AS passed
    FROM (VALUES ('auc_roc', '>=', {C.GATE_MIN_AUC}::DOUBLE), ('average_precision', '>=', {C.GATE_MIN_AP}::DOUBLE),
                 ('ece', '<=', {C.GATE_MAX_ECE}::DOUBLE)) g(metric, op, bound)
    LEFT JOIN ({_REPORT_SQL}) r USING (metric)""", _REPORT_CTES))
