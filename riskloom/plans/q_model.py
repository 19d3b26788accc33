"""Registered queries: feature ranking/consensus (2.7), models and calibration (2.8)."""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import information as INF
from riskloom.operators import model as MD
from riskloom.operators import selection as SEL
from riskloom.operators import trees as TR
from riskloom.operators.metrics import _long, auc_table
from riskloom.plans.oracle import oracle
from riskloom.plans.q_features import split_sql
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import PIPE_NUMS, with_cleaned, with_pipeline
from riskloom.session import FILE_ROWS, scratch_path
from riskloom.sources.encounters import encounters
from riskloom.sources.tables import read_table

KEY = "encounter_id"
LABEL = C.LABEL_COL
# Written feature matrices and fitted models by application, input files and settings.
_MADE: dict = {}


def input_key(spark, sf_dir, *settings) -> str:
    """Names what is made of the input files as they are now: path, size and time of
    each, the application and the settings."""
    files = []
    for t in ("customer", "lineitem", "orders"):
        m = read_table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        files += sorted(tuple(map(str, r)) for r in m.distinct().collect())
    return hashlib.md5(repr((spark.sparkContext.applicationId, files, settings)).encode()).hexdigest()[:16]


def prepared(spark, sf_dir):
    """The train-fitted feature matrix, written once per application and input under
    the shared checkpoint folder (cuts the long lineage for the many model jobs)."""
    k = "pipeline_" + input_key(spark, sf_dir)
    if k not in _MADE:
        from riskloom.operators.pipeline import run_feature_pipeline
        res = run_feature_pipeline(encounters(spark, sf_dir))
        path = scratch_path(spark, k)
        res.data.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("split").parquet(path)
        _MADE[k] = (path, res.feature_names, res.medians)
    path, names, _ = _MADE[k]
    return spark.read.parquet(path), names


def prepared_medians(spark, sf_dir) -> dict:
    prepared(spark, sf_dir)
    return _MADE["pipeline_" + input_key(spark, sf_dir)][2]


def _splits(spark, sf_dir):
    d, names = prepared(spark, sf_dir)
    return (d.where(F.col("split") == "train"), d.where(F.col("split") == "val"),
            d.where(F.col("split") == "test"), names)


def _pipe_sql(body, extra=""):
    return with_pipeline(body, split_sql("cleaned"), extra)


# ---- 2.7 ranking ---------------------------------------------------------------------------
@query("balanced_weights")
def q_balanced_weights(spark, sf_dir):
    from riskloom.plans.common import cleaned
    return SEL.balanced_weights(cleaned(spark, sf_dir), LABEL)


oracle("balanced_weights", with_cleaned(
    f"SELECT {LABEL}, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) "
    f"AS weight FROM cleaned GROUP BY {LABEL}"))


@query("class_ratio")
def q_class_ratio(spark, sf_dir):
    from riskloom.plans.common import cleaned
    r = MD.class_ratio(cleaned(spark, sf_dir), LABEL)
    return spark.createDataFrame([(round(r, 6),)], "scale_pos_weight double")


oracle("class_ratio", with_cleaned(
    f"SELECT round(count_if({LABEL} = 0) / count_if({LABEL} = 1), 6) AS scale_pos_weight FROM cleaned"))


def _mi_sql(src="imp WHERE split = 'train'", bins=20):
    parts = []
    for c in PIPE_NUMS:
        b = (f"CASE WHEN hi = lo THEN 0 ELSE least(floor(({c} - lo) / (hi - lo) * {float(bins)}), "
             f"{bins - 1}) END")
        parts.append(
            f"SELECT '{c}' AS feature, {b} AS bin, {LABEL} AS y FROM (SELECT * FROM {src}) t "
            f"CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM {src}) r")
    return ("mi AS (SELECT feature, sum(nby / n * ln(nby * n / (nb * ny))) AS mi_score FROM ("
            "SELECT feature, nby, sum(nby) OVER (PARTITION BY feature, bin) AS nb, "
            "sum(nby) OVER (PARTITION BY feature, y) AS ny, sum(nby) OVER (PARTITION BY feature) AS n "
            "FROM (SELECT feature, bin, y, count(*) AS nby FROM (" + " UNION ALL ".join(parts)
            + ") l GROUP BY 1, 2, 3) j) t GROUP BY feature)")


def _psi_sql(n):
    """The digamma series of ``information.digamma``."""
    x, y = f"({n})::DOUBLE", f"(({n})::DOUBLE + {float(INF.SHIFT)})"
    s = f"(1.0 / ({y} * {y}))"
    back = " ".join(f"- 1.0 / ({x} + {float(i)})" for i in range(INF.SHIFT))
    return f"(ln({y}) - 0.5 / {y} - {s} * (1 / 12.0 - {s} * (1 / 120.0 - {s} * (1 / 252.0 - {s} * (1 / 240.0)))) {back})"


def _knn_sql(k=3):
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {LABEL} AS y, CAST({c} AS DOUBLE) AS value FROM imp WHERE split = 'train'" for c in PIPE_NUMS)
    near = ", ".join(f"list_transform(range(0, least(coalesce(n_{f}_{i}, 0), {k})), lambda j: abs(value - x_{f}_{i}))"
                     for i in range(1, k + 1) for f in ("lag", "lead"))
    steps = ", ".join(f"{f}(value, {i}) OVER w AS x_{f}_{i}, {f}(n, {i}) OVER w AS n_{f}_{i}" for i in range(1, k + 1) for f in ("lag", "lead"))
    return (f"ml AS ({rows}), mn AS (SELECT feature, y, value, count(*) AS n FROM ml WHERE isfinite(value) GROUP BY 1, 2, 3), "
            f"mw AS (SELECT *, sum(n) OVER (PARTITION BY feature, y) AS nc, {steps} FROM mn WINDOW w AS (PARTITION BY feature, y ORDER BY value)), "
            f"mr AS (SELECT feature, y, value, n, nc, least({k}, nc - 1) AS kc, CASE WHEN n > least({k}, nc - 1) THEN 0.0 "
            f"ELSE list_sort(flatten([{near}]))[CAST(least({k}, nc - 1) - n + 1 AS BIGINT)] END AS r FROM mw WHERE nc > 1), "
            "mv AS (SELECT feature, value AS v, sum(n) AS nv FROM mr GROUP BY 1, 2), "
            "mm AS (SELECT t.feature, t.y, t.value, t.n, t.nc, CASE WHEN t.r = 0 THEN t.n ELSE t.kc END AS kt, sum(nv) AS m FROM mr t JOIN mv "
            "ON mv.feature = t.feature AND v >= t.value - t.r AND v <= t.value + t.r AND (t.r = 0 OR (v > t.value - t.r AND v < t.value + t.r)) "
            "GROUP BY ALL), "
            f"knn AS (SELECT feature, greatest(0, {_psi_sql('sum(n)')} + sum(n * ({_psi_sql('kt')} - {_psi_sql('nc')} - {_psi_sql('m')})) / sum(n)) "
            "AS mi_score FROM mm GROUP BY feature)")


@query("rank_mutual_info")
def q_rank_mi(spark, sf_dir):
    tr, _, _, names = _splits(spark, sf_dir)
    return INF.neighbour_information(tr, names, LABEL).select("feature", F.round("mi_score", 6).alias("mi_score"))


oracle("rank_mutual_info", _pipe_sql("SELECT feature, round(mi_score, 6) AS mi_score FROM knn", _knn_sql()))


@query("rank_binned_info")
def q_rank_binned(spark, sf_dir):
    """The plug-in estimate over equal-width bins: one aggregation, for a quick look."""
    tr, _, _, names = _splits(spark, sf_dir)
    return SEL.mutual_info(tr, names, LABEL).select("feature", F.round("mi_score", 6).alias("mi_score"))


oracle("rank_binned_info", _pipe_sql("SELECT feature, round(mi_score, 6) AS mi_score FROM mi", _mi_sql()))


def _sql_rankings():
    src = "imp WHERE split = 'train'"
    corr = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN isfinite(corr({c}, cast({LABEL} AS DOUBLE))) THEN abs(corr({c}, cast({LABEL} AS DOUBLE))) ELSE 0 END AS score FROM {src}"
        for c in PIPE_NUMS)
    smd = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(abs(avg(CASE WHEN {LABEL} = 1 THEN {c} END) - "
        f"avg(CASE WHEN {LABEL} = 0 THEN {c} END)) / CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) END, 0) "
        f"AS score FROM {src}" for c in PIPE_NUMS)
    return (_mi_sql() + ",\n"
            f"scores AS (SELECT feature, 'mi' AS method, mi_score AS score FROM mi "
            f"UNION ALL SELECT feature, 'abs_corr', score FROM ({corr}) a "
            f"UNION ALL SELECT feature, 'smd', score FROM ({smd}) s),\n"
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(score, 9) DESC, feature) - 1 "
            "AS rank FROM scores),\n"
            f"tops AS (SELECT feature, count(*) AS n_top FROM ranked WHERE rank < {C.TOP_K} GROUP BY feature),\n"
            "cons AS (SELECT r.feature, max(CASE WHEN method = 'mi' THEN rank END) AS mi_rank, "
            "max(CASE WHEN method = 'abs_corr' THEN rank END) AS abs_corr_rank, "
            "max(CASE WHEN method = 'smd' THEN rank END) AS smd_rank, max(n_top) AS n_top "
            "FROM ranked r JOIN tops t USING (feature) GROUP BY r.feature)")


def _sql_consensus(spark, sf_dir):
    tr, _, _, names = _splits(spark, sf_dir)      # a written table: nothing is left cached
    return SEL.consensus({"mi": SEL.mutual_info(tr, names, LABEL),
                          "abs_corr": SEL.abs_correlation(tr, names, LABEL),
                          "smd": SEL.mean_difference(tr, names, LABEL)}, C.TOP_K)


@query("feature_consensus")
def q_feature_consensus(spark, sf_dir):
    return _sql_consensus(spark, sf_dir)


oracle("feature_consensus", _pipe_sql(
    "SELECT feature, mi_rank, abs_corr_rank, smd_rank, round((mi_rank + abs_corr_rank + smd_rank) / 3.0, 6) "
    "AS mean_rank, n_top = 3 AS in_all_3, n_top >= 2 AS in_2plus FROM cons", _sql_rankings()))


@query("rank_normalised")
def q_rank_normalised(spark, sf_dir):
    return SEL.rank_normalised(_sql_consensus(spark, sf_dir), ["mi", "abs_corr", "smd"])


oracle("rank_normalised", _pipe_sql(
    "SELECT feature, " + ", ".join(f"round(1 - {m}_rank / count(*) OVER (), 6) AS {m}_norm"
                                   for m in ("mi", "abs_corr", "smd")) + " FROM cons", _sql_rankings()))


@query("rank_join")
def q_rank_join(spark, sf_dir):
    """Every feature's rank in each method (full outer join of the ranking tables)."""
    from pyspark.sql import Window
    tr, _, _, names = _splits(spark, sf_dir)
    tabs = {"mi": SEL.mutual_info(tr, names, LABEL), "abs_corr": SEL.abs_correlation(tr, names, LABEL),
            "smd": SEL.mean_difference(tr, names, LABEL)}
    out = None
    for m, t in tabs.items():
        sc = [c for c in t.columns if c != "feature"][0]
        # each ranking has one row per feature: a global window over it is schema-bounded.
        r = t.select("feature", (F.row_number().over(Window.orderBy(F.desc(F.round(sc, 9)), "feature")) - 1)
                     .cast("long").alias(f"{m}_rank"))
        out = r if out is None else out.join(r, "feature", "full")
    return out


oracle("rank_join", _pipe_sql("SELECT feature, mi_rank, abs_corr_rank, smd_rank FROM "
                              "(SELECT feature, max(CASE WHEN method = 'mi' THEN rank END) AS mi_rank, "
                              "max(CASE WHEN method = 'abs_corr' THEN rank END) AS abs_corr_rank, "
                              "max(CASE WHEN method = 'smd' THEN rank END) AS smd_rank FROM ranked "
                              "GROUP BY feature) x", _sql_rankings()))


@query("topk_set_algebra")
def q_topk_sets(spark, sf_dir):
    c = _sql_consensus(spark, sf_dir)
    return c.agg(F.count_if("in_all_3").alias("in_all_3"), F.count_if("in_2plus").alias("in_2plus"),
                 F.count(F.lit(1)).alias("union_size"))


oracle("topk_set_algebra", _pipe_sql(
    "SELECT count_if(n_top = 3) AS in_all_3, count_if(n_top >= 2) AS in_2plus, count(*) AS union_size "
    "FROM cons", _sql_rankings()))


@query("rank_lasso")
def q_rank_lasso(spark, sf_dir):
    tr, _, _, names = _splits(spark, sf_dir)
    return SEL.lasso_coefficients(tr, names, LABEL)


@query("rank_forest")
def q_rank_forest(spark, sf_dir):
    tr, _, _, names = _splits(spark, sf_dir)
    return SEL.forest_importance(tr.cache(), names, LABEL)


@query("select_top_features")
def q_select_top(spark, sf_dir):
    tr, _, _, names = _splits(spark, sf_dir)
    _, cons = SEL.select_top_features(tr.cache(), names, LABEL)
    return cons


# ---- 2.8 models -----------------------------------------------------------------------------
def _fit_small(spark, sf_dir):
    tr, va, te, names = _splits(spark, sf_dir)
    return fitted(spark, sf_dir), tr, va, te, names


def gbt_settings(spark) -> dict:
    """The configured settings; ``spark.riskloom.trees`` sets another tree count (tests do)."""
    trees = spark.conf.get("spark.riskloom.trees", None)
    return dict(C.GBT_DEFAULTS, **({"n_estimators": int(trees)} if trees else {}))


def fitted_path(spark, sf_dir) -> str:
    """Where the boosted trees of the configured settings are stored: fitted once per
    application and input, loaded by every query that needs them."""
    settings = gbt_settings(spark)
    k = "gbt_" + input_key(spark, sf_dir, sorted(settings.items()))
    if k not in _MADE:
        tr, _, _, names = _splits(spark, sf_dir)
        path = scratch_path(spark, k)
        MD.fit_gbt(tr, names, LABEL, settings).write().overwrite().save(path)
        _MADE[k] = path
    return _MADE[k]


def fitted(spark, sf_dir):
    return PipelineModel.load(fitted_path(spark, sf_dir))


def fitted_nodes(spark, sf_dir):
    """Its node table."""
    return TR.node_table(spark, fitted_path(spark, sf_dir))


@query("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    m, _, va, _, _ = _fit_small(spark, sf_dir)
    return MD.score(m, va).select(KEY, LABEL, F.round("raw_score", 6).alias("raw_score"))


@query("fit_gbt_early_stop")
def q_fit_gbt_es(spark, sf_dir):
    """Validation scores of the trees up to the best round (patience of 50 rounds)."""
    _, va, _, names = _splits(spark, sf_dir)
    nodes = fitted_nodes(spark, sf_dir)
    rounds, aucs = TR.early_stop(nodes, va, names, LABEL)
    return TR.with_margin(va, names, TR.cut(nodes, rounds), [KEY]).select(
        KEY, F.round("raw_score", 6).alias("raw_score"), F.lit(rounds).alias("n_trees"), F.lit(len(aucs)).alias("n_rounds"),
        F.lit(round(max(aucs), 6) if aucs else None).cast("double").alias("best_auc"))


@query("fit_logistic_baseline")
def q_fit_logistic(spark, sf_dir):
    from riskloom.operators.metrics import average_precision
    tr, va, _, names = _splits(spark, sf_dir)
    m = MD.fit_logistic(tr, names, LABEL)
    s = MD.score(m, va).select(F.col(LABEL).alias("label"), F.col("raw_score").alias("score")).cache()
    return _long(auc_table(s), {"val_auc": F.round("auc_roc", 6)}) \
        .unionByName(_long(average_precision(s), {"val_ap": "average_precision"}))


def search_trials(spark, sf_dir):
    """The trials table of the whole search (``C.N_TRIALS`` draws from ``C.SEARCH_SPACE``),
    written once per application and input."""
    trees = spark.conf.get("spark.riskloom.trees", None)
    space = dict(C.SEARCH_SPACE, **({"n_estimators": (int(trees), int(trees))} if trees else {}))
    k = "trials_" + input_key(spark, sf_dir, C.N_TRIALS, sorted(space.items()))
    if k not in _MADE:
        tr, va, _, names = _splits(spark, sf_dir)
        path = scratch_path(spark, k)
        MD.hyper_search(tr, va, names, LABEL, space=space).write.mode("overwrite").parquet(path)
        _MADE[k] = path
    return spark.read.parquet(_MADE[k])


@query("hyper_search")
def q_hyper_search(spark, sf_dir):
    return search_trials(spark, sf_dir)


@query("search_convergence")
def q_search_convergence(spark, sf_dir):
    """Best validation AUC so far over the trials of ``hyper_search``."""
    return MD.search_convergence(search_trials(spark, sf_dir))


@query("best_trial")
def q_best_trial(spark, sf_dir):
    """Parameters and AUC of the best of these trials."""
    return MD.best_trial(search_trials(spark, sf_dir))


def _calibrated(spark, sf_dir):
    m, tr, va, te, names = _fit_small(spark, sf_dir)
    sv = MD.score(m, va).cache()
    iso = MD.fit_isotonic(sv, LABEL)
    return MD.RiskModel(m, names, iso), sv, te


@query("calibrate_isotonic")
def q_calibrate(spark, sf_dir):
    rm, sv, _ = _calibrated(spark, sf_dir)
    out = rm.calibrator.transform(sv)
    return out.select(KEY, F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"))


@query("predict_proba")
def q_predict_proba(spark, sf_dir):
    rm, _, te = _calibrated(spark, sf_dir)
    return rm.predict_proba(te).select(KEY, F.round("score", 6).alias("score"))


@query("model_importance")
def q_model_importance(spark, sf_dir):
    m, *_ , names = _fit_small(spark, sf_dir)
    rm = MD.RiskModel(m, names)
    return spark.createDataFrame([(f, round(v, 6)) for f, v in rm.importance(20)],
                                 "feature string, importance double")


@query("model_save_load")
def q_model_save_load(spark, sf_dir):
    rm, _, te = _calibrated(spark, sf_dir)
    path = scratch_path(spark, "model_" + input_key(spark, sf_dir))
    rm.save(path)
    back = MD.RiskModel.load(path, rm.features)
    a = rm.predict_proba(te).select(KEY, F.col("score").alias("a"))
    b = back.predict_proba(te).select(KEY, F.col("score").alias("b"))
    return a.join(b, KEY).select(KEY, F.round("a", 6).alias("score"), (F.col("a") == F.col("b")).alias("same"))


@query("run_training")
def q_run_training(spark, sf_dir):
    """A whole run (search, fit, calibration, evaluation, tiers) as a version of a model
    folder; its metrics for val and test as read back (long table)."""
    from riskloom.operators.training import load_run, train
    tr, va, te, names = _splits(spark, sf_dir)
    path = scratch_path(spark, "training_" + input_key(spark, sf_dir))
    train(tr, va, te, names, LABEL, path, trials=search_trials(spark, sf_dir))
    return load_run(spark, path).table("metrics")


@query("before_after_calibration")
def q_before_after(spark, sf_dir):
    from riskloom.operators.metrics import average_precision, ece_mce
    rm, sv, _ = _calibrated(spark, sf_dir)
    cal = rm.calibrator.transform(sv)
    out = None
    for variant, col in (("raw", "raw_score"), ("calibrated", "score")):
        s = cal.select(F.col(LABEL).alias("label"), F.col(col).alias("score")).cache()
        rows = _long(auc_table(s), {"auc_roc": F.round("auc_roc", 6)}) \
            .unionByName(_long(average_precision(s), {"average_precision": "average_precision"})) \
            .unionByName(_long(ece_mce(s), {"ece": "ece"})).withColumn("variant", F.lit(variant))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("evaluate_standalone")
def q_evaluate_standalone(spark, sf_dir):
    """Evaluate a stored model on the test split: only what lies in its folder is used
    (the trees are fitted and stored once per application and input, not here)."""
    from riskloom.operators.metrics import headline_metrics
    k = "stored_" + input_key(spark, sf_dir, sorted(gbt_settings(spark).items()))
    if k not in _MADE:
        _calibrated(spark, sf_dir)[0].save(scratch_path(spark, k))
        _MADE[k] = scratch_path(spark, k)
    _, _, te, names = _splits(spark, sf_dir)
    s = MD.RiskModel.load(_MADE[k], names).predict_proba(te).select(F.col(LABEL).alias("label"), "score")
    return headline_metrics(s)
