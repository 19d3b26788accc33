"""Scored-population metrics over ``(label 0/1, score double)``.

Everything reduces first to the distinct-score table ``(score, n, pos)`` (a
map-side-combined aggregation whose size is the number of distinct scores,
not rows).  Curve metrics then use distributed prefix sums; threshold-grid
metrics bucket scores onto the fixed grid and need only a grid-sized table.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.cumulative import exact_quantiles, prefix_sums
from riskloom.functions.exprs import left_closed_bin, linspace
from riskloom.session import written

EPS64 = 2.220446049250313e-16   # float64 machine epsilon (log-loss clip)


def score_table(scored: DataFrame, score="score", label="label", group_cols=()) -> DataFrame:
    return (scored.groupBy(*group_cols, score)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
            .withColumn("neg", F.col("n") - F.col("pos")))


# ---- ranking metrics ---------------------------------------------------------------
def auc_table(scored: DataFrame, score="score", label="label", group_cols=()) -> DataFrame:
    """AUC (ties count half) per group: Σ pos_s · (neg below s + ½ neg_s) / (P·N)."""
    t = score_table(scored, score, label, group_cols)
    ps = prefix_sums(t, score, {"_cneg": F.col("neg")}, group_cols=group_cols)
    contrib = F.col("pos") * (F.col("_cneg") - F.col("neg") + 0.5 * F.col("neg"))
    a = ps.groupBy(*group_cols).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"),
                                    F.sum("neg").alias("n_neg"), F.sum(contrib).alias("_u"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return a.select(*group_cols, "n", "n_pos", "n_neg", auc.alias("auc_roc"))


def auc_roc(scored: DataFrame, score="score", label="label") -> DataFrame:
    return auc_table(scored, score, label).select(F.round("auc_roc", 6).alias("auc_roc"))


def _desc_curve(scored, score, label) -> DataFrame:
    t = score_table(scored, score, label)
    return prefix_sums(t, score, {"tps": F.col("pos"), "fps": F.col("neg"),
                                  "idx": F.lit(1).cast("long")}, descending=True)


def average_precision(scored: DataFrame, score="score", label="label") -> DataFrame:
    """Σ (R_i − R_{i−1}) · P_i over descending distinct thresholds (step rule)."""
    c = _desc_curve(scored, score, label)
    a = c.agg(F.sum("pos").alias("P"),
              F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("_s"))
    return a.select(F.round(F.when(F.col("P") > 0, F.col("_s") / F.col("P")), 6)
                    .alias("average_precision"))


def roc_curve(scored: DataFrame, score="score", label="label",
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) at distinct thresholds, descending, starting at (inf, 0, 0);
    collinear interior points dropped like the common implementation."""
    c = _desc_curve(scored, score, label).select(score, "tps", "fps", "idx").cache()
    tot = c.agg(F.max("tps").alias("P"), F.max("fps").alias("N")).first()
    keep = F.lit(True)
    if drop_intermediate:
        prev = c.select((F.col("idx") + 1).alias("idx"), F.col("tps").alias("tp_prev"),
                        F.col("fps").alias("fp_prev"))
        nxt = c.select((F.col("idx") - 1).alias("idx"), F.col("tps").alias("tp_next"),
                       F.col("fps").alias("fp_next"))
        c = c.join(prev, "idx", "left").join(nxt, "idx", "left")
        second = ((F.col("fp_prev") - 2 * F.col("fps") + F.col("fp_next")) != 0) | \
                 ((F.col("tp_prev") - 2 * F.col("tps") + F.col("tp_next")) != 0)
        keep = F.col("tp_prev").isNull() | F.col("tp_next").isNull() | second
    pts = c.where(keep).select(F.col(score).cast("double").alias("threshold"),
                               F.round(F.col("fps") / F.lit(tot["N"]), 6).alias("fpr"),
                               F.round(F.col("tps") / F.lit(tot["P"]), 6).alias("tpr"))
    start = scored.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)],
                                                "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def pr_curve(scored: DataFrame, score="score", label="label") -> DataFrame:
    """(threshold, precision, recall, base_rate) from the highest threshold down to the
    first one reaching full recall, plus the (precision 1, recall 0) end point."""
    c = _desc_curve(scored, score, label).cache()
    P, total = (lambda r: (r["P"], r["total"]))(
        c.agg(F.max("tps").alias("P"), F.sum("n").alias("total")).first())
    last = c.where(F.col("tps") == F.lit(P)).agg(F.min("idx").alias("m")).first()["m"]
    base = round(P / total, 6) if total else None
    pts = c.where(F.col("idx") <= F.lit(last)).select(
        F.col(score).cast("double").alias("threshold"),
        F.round(F.col("tps") / (F.col("tps") + F.col("fps")), 6).alias("precision"),
        F.round(F.col("tps") / F.lit(P), 6).alias("recall"),
        F.lit(base).cast("double").alias("base_rate"))
    end = scored.sparkSession.createDataFrame(
        [(None, 1.0, 0.0, base)], "threshold double, precision double, recall double, base_rate double")
    return pts.unionByName(end)


# ---- probabilistic metrics ----------------------------------------------------------
def brier_logloss(scored: DataFrame, score="score", label="label") -> DataFrame:
    p, y = F.col(score), F.col(label)
    pc = F.least(F.greatest(p, F.lit(EPS64)), F.lit(1 - EPS64))
    return scored.agg(
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc)), 6).alias("log_loss"))


def calibration_bins(scored: DataFrame, n_bins=C.CALIBRATION_BINS, score="score",
                     label="label") -> DataFrame:
    """[lo, hi) bins on linspace(0, 1, n+1) edges (binary-float edges as literals);
    a score equal to the last edge is in no bin but counts in the total."""
    edges = linspace(0.0, 1.0, n_bins + 1)
    b = scored.select(left_closed_bin(score, edges).alias("bin"), F.col(score), F.col(label))
    g = b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("acc"), F.avg(score).alias("conf"))
    # the in-no-bin rows (bin NULL) stay in the total; the table has ≤ n_bins + 1 rows.
    w = Window.partitionBy(F.lit(1))
    return g.withColumn("total", F.sum("n").over(w)).where(F.col("bin").isNotNull()) \
        .withColumn("gap", F.abs(F.col("acc") - F.col("conf")))


def ece_mce(scored: DataFrame, n_bins=C.CALIBRATION_BINS, score="score", label="label") -> DataFrame:
    b = calibration_bins(scored, n_bins, score, label)
    return b.agg(F.round(F.coalesce(F.sum(F.col("n") / F.col("total") * F.col("gap")), F.lit(0.0)), 6)
                 .alias("ece"),
                 F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 6).alias("mce"))


def reliability_table(scored: DataFrame, n_bins=C.CALIBRATION_BINS, score="score",
                      label="label") -> DataFrame:
    """Right-closed uniform bins (0 in the first), empty bins dropped."""
    inner = linspace(0.0, 1.0, n_bins + 1)[1:-1]
    binid = sum((F.col(score) > F.lit(e)).cast("int") for e in inner)
    return scored.groupBy(binid.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(label), 6).alias("prob_true"),
        F.round(F.avg(score), 6).alias("prob_pred"))


def score_histogram(scored: DataFrame, bins: int = 40, score="score", label="label") -> DataFrame:
    """Per-class histogram over that class's own [min, max] (last bin closed)."""
    rng = {r[label]: (r["lo"], r["hi"]) for r in
           scored.groupBy(label).agg(F.min(score).alias("lo"), F.max(score).alias("hi")).collect()}
    expr = None
    for cls, (lo, hi) in rng.items():
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        inner = linspace(lo, hi, bins + 1)[1:-1]
        b = F.least(sum((F.col(score) >= F.lit(e)).cast("int") for e in inner), F.lit(bins - 1))
        cond = F.col(label) == cls
        expr = F.when(cond, b) if expr is None else expr.when(cond, b)
    h = scored.where(F.col(score).isNotNull()).groupBy(label, expr.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return h


# ---- threshold-grid metrics ------------------------------------------------------------
def _grid_counts(scored: DataFrame, grid: list[float], score="score", label="label") -> DataFrame:
    """For each grid threshold t_j: tp_j = #pos with s ≥ t_j, fp_j likewise.

    Scores are bucketed onto the grid (bucket b holds t_{b-1} ≤ s < t_b), counted per
    bucket, equi-joined to the grid on j = b − 1 and reverse-cumulated over the grid —
    every table after the first aggregation has at most len(grid) + 1 rows.
    """
    splits = [-math.inf] + list(grid) + [math.inf]
    b = Bucketizer(splits=splits, inputCol="_s", outputCol="_b", handleInvalid="skip")
    counts = b.transform(scored.select(F.col(score).cast("double").alias("_s"),
                                       F.col(label).alias("_y"))) \
        .groupBy((F.col("_b").cast("int") - 1).alias("j")) \
        .agg(F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n"))
    g = scored.sparkSession.createDataFrame([(j, float(t)) for j, t in enumerate(grid)],
                                            "j int, threshold double")
    # the grid has at most len(grid) rows: one ordered window over it is bounded.
    rev = Window.partitionBy(F.lit(1)).orderBy(F.desc("j")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    j = g.join(counts, "j", "left").select(
        "j", "threshold", F.sum(F.coalesce("pos", F.lit(0))).over(rev).alias("tp"),
        F.sum(F.coalesce("n", F.lit(0))).over(rev).alias("flagged"))
    t = counts.agg(F.sum("pos").alias("P"), F.sum("n").alias("total")).first()
    P, total = t["P"] or 0, t["total"] or 0
    return j.select("j", "threshold", "tp", (F.col("flagged") - F.col("tp")).alias("fp"),
                    "flagged", F.lit(P).alias("P"), F.lit(total).alias("total"),
                    F.lit(total - P).alias("N"))


def ks_stat(scored: DataFrame, n_thresholds=C.KS_THRESHOLDS, score="score", label="label") -> DataFrame:
    g = _grid_counts(scored, linspace(0.0, 1.0, n_thresholds), score, label)
    tpr = F.when(F.col("P") > 0, F.col("tp") / F.col("P"))
    fpr = F.when(F.col("N") > 0, F.col("fp") / F.col("N"))
    return g.agg(F.round(F.coalesce(F.max(F.abs(tpr - fpr)), F.lit(0.0)), 6).alias("ks_statistic"))


def threshold_sweep(scored: DataFrame, n_points=C.SWEEP_POINTS, score="score", label="label") -> DataFrame:
    g = _grid_counts(scored, linspace(0.01, 0.99, n_points), score, label)
    fn = F.col("P") - F.col("tp")
    return g.where(F.col("flagged") > 0).select(
        F.round("threshold", 6).alias("threshold"),
        F.round(F.col("tp") / F.col("flagged"), 6).alias("precision"),
        F.round(F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(2 * F.col("tp") + F.col("fp") + fn > 0,
                       2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn)).otherwise(0.0), 6)
        .alias("f1"),
        F.round(F.col("flagged") / F.col("total"), 6).alias("flagged_pct"))


def best_f1(scored: DataFrame, score="score", label="label") -> DataFrame:
    """First threshold of maximal F1 on the sweep grid."""
    s = threshold_sweep(scored, score=score, label=label)
    # the sweep has at most n_points rows; this order/limit runs on that small table.
    return s.orderBy(F.desc("f1"), F.asc("threshold")).limit(1) \
        .select(F.col("f1").alias("best_f1"), F.col("threshold").alias("best_f1_threshold"))


# ---- confusion-based -------------------------------------------------------------------
def confusion_matrix(scored: DataFrame, threshold: float | Column = 0.5, score="score",
                     label="label") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return scored.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
                      F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))


def predict_class(scored: DataFrame, threshold=0.5, score="score") -> DataFrame:
    return scored.withColumn("pred", (F.col(score) >= threshold).cast("int"))


def clinical_utility(scored: DataFrame, flag_percentile=C.FLAG_PERCENTILE, score="score",
                     label="label") -> DataFrame:
    """Flag score ≥ P(flag_percentile) of scores: ppv, npv, sensitivity, specificity, NNT."""
    (thr,) = exact_quantiles(scored.select(score), score, [flag_percentile / 100.0])
    cm = confusion_matrix(scored, thr, score, label)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ppv = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    return cm.select(
        F.round(F.lit(thr), 6).alias("threshold"),
        F.round(F.lit(1 - flag_percentile / 100.0), 6).alias("flag_pct"),
        F.round(ppv, 6).alias("ppv"),
        F.round(F.when(tn + fn > 0, tn / (tn + fn)).otherwise(0.0), 6).alias("npv"),
        F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), 6).alias("sensitivity"),
        F.round(F.when(tn + fp > 0, tn / (tn + fp)).otherwise(0.0), 6).alias("specificity"),
        F.round(F.when(ppv > 0, 1 / ppv).otherwise(F.lit(math.inf)), 6).alias("nnt"),
        "tp", "fp", "tn", "fn",
        (tp * C.INTERVENTION_EFFICACY * C.READMISSION_COST).cast("double").alias("est_savings_usd"))


def classification_report(scored: DataFrame, threshold=0.5, score="score", label="label") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    cm = confusion_matrix(scored, threshold, score, label)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def prf(tp_, fp_, fn_):
        p = F.when(tp_ + fp_ > 0, tp_ / (tp_ + fp_)).otherwise(0.0)
        r = F.when(tp_ + fn_ > 0, tp_ / (tp_ + fn_)).otherwise(0.0)
        f = F.when(2 * tp_ + fp_ + fn_ > 0, 2 * tp_ / (2 * tp_ + fp_ + fn_)).otherwise(0.0)
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            ("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
             (f0 * s0 + f1 * s1) / n, n)]
    structs = [F.struct(F.lit(k).alias("class"), F.round(p, 6).alias("precision"),
                        F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"),
                        s.alias("support")) for k, p, r, f, s in rows]
    return cm.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def score_deciles(scored: DataFrame, q: int = 10, score="score", label="label") -> DataFrame:
    """Quantile bins like qcut(duplicates='drop'): right-closed, lowest included."""
    probs = linspace(0.0, 1.0, q + 1)
    edges = sorted(set(exact_quantiles(scored.select(score), score, probs)))
    k = F.greatest(sum((F.col(score) > F.lit(e)).cast("long") for e in edges) - 1, F.lit(0).cast("long"))
    return scored.groupBy(k.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(label), 6).alias("readmission_rate"),
        F.round(F.avg(score), 6).alias("mean_score"))


# ---- summary ------------------------------------------------------------------------------
def metric_row(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))


def _long(df: DataFrame, names: dict) -> DataFrame:
    rows = [metric_row(k, v if isinstance(v, Column) else F.col(v)) for k, v in names.items()]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def ranking_metrics(scored: DataFrame, score="score", label="label") -> DataFrame:
    """AUC (ties half) and average precision from one descending cumulative curve:
    AUC = Σ neg_s · (tp(s) − pos_s + ½ pos_s) / (P·N), AP = Σ pos_s · precision(s) / P."""
    c = _desc_curve(scored, score, label)
    a = c.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"),
              F.sum(F.col("neg") * (F.col("tps") - 0.5 * F.col("pos"))).alias("_u"),
              F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("_s"))
    auc = F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_u") / (F.col("_p") * F.col("_q")))
    return a.select(F.round(auc, 6).alias("auc_roc"),
                    F.round(F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")), 6).alias("average_precision"))


def gate_metrics(scored: DataFrame, score="score", label="label") -> DataFrame:
    """The three metrics that the quality gate reads."""
    scored = written(scored.select(score, label), "scored")
    return _long(ranking_metrics(scored, score, label), {"auc_roc": "auc_roc", "average_precision": "average_precision"}) \
        .unionByName(_long(ece_mce(scored, score=score, label=label), {"ece": "ece"}))


def headline_metrics(scored: DataFrame, score="score", label="label") -> DataFrame:
    """Long ``(metric, value)``: auc, ap, brier, log loss, ks, gini, ece, mce, best F1,
    clinical utility — one row each (a union of single-row aggregates over one written
    two-column table, so the scored input is derived once)."""
    scored = written(scored.select(score, label), "scored")
    parts = [
        _long(ranking_metrics(scored, score, label),
              {"auc_roc": "auc_roc", "gini": F.round(2 * F.col("auc_roc") - 1, 6),
               "average_precision": "average_precision"}),
        _long(brier_logloss(scored, score, label), {"brier": "brier", "log_loss": "log_loss"}),
        _long(ks_stat(scored, score=score, label=label), {"ks_statistic": "ks_statistic"}),
        _long(ece_mce(scored, score=score, label=label), {"ece": "ece", "mce": "mce"}),
        _long(best_f1(scored, score, label),
              {"best_f1": "best_f1", "best_f1_threshold": "best_f1_threshold"}),
        _long(clinical_utility(scored, score=score, label=label),
              {"ppv": "ppv", "npv": "npv", "sensitivity": "sensitivity",
               "specificity": "specificity", "nnt": "nnt", "clinical_threshold": "threshold",
               "est_savings_usd": "est_savings_usd"}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
