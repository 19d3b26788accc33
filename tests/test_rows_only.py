"""Invariants for the model- and stream-dependent registered queries (no SQL oracle)."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom import config as C
from tests.conftest import SF001


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    spark.conf.set("spark.riskloom.trees", "12")
    yield lambda name: qs[name](spark, SF001)
    spark.conf.unset("spark.riskloom.trees")


def test_rankings(q):
    lasso = q("rank_lasso").toPandas()
    assert len(lasso) > 20 and (lasso["lasso_coef"] >= 0).all()
    rf = q("rank_forest").toPandas()
    assert math.isclose(rf["rf_importance"].sum(), 1.0, abs_tol=1e-6)
    cons = q("select_top_features").toPandas()
    assert 0 < len(cons) <= 3 * C.TOP_K
    assert (cons["mean_rank"] >= 0).all()


def test_model_queries(q):
    es = q("fit_gbt_early_stop").toPandas()
    assert 1 <= es["n_trees"].iloc[0] <= es["n_rounds"].iloc[0] <= 12 and es["raw_score"].between(0, 1).all()
    assert 0 <= es["best_auc"].iloc[0] <= 1
    lb = q("fit_logistic_baseline").toPandas().set_index("metric")
    assert 0 <= lb.loc["val_auc", "value"] <= 1
    cal = q("calibrate_isotonic").toPandas().sort_values("raw_score")
    assert cal["score"].is_monotonic_increasing
    imp = q("model_importance").toPandas()
    assert len(imp) <= 20 and imp["importance"].is_monotonic_decreasing
    same = q("model_save_load").toPandas()
    assert same["same"].all()


def test_search_over_its_own_trials(q):
    trials = q("hyper_search").toPandas().sort_values("trial")
    curve = q("search_convergence").toPandas().sort_values("trial")
    assert list(curve["val_auc"]) == list(trials["val_auc"]) and list(curve["best_so_far"]) == list(trials["val_auc"].cummax())
    best = q("best_trial").toPandas()
    assert len(best) == 1 and best["val_auc"].iloc[0] == trials["val_auc"].max() and {"learning_rate", "max_depth", "n_estimators"} <= set(best.columns)
    assert tuple(best.iloc[0]) in {tuple(r) for r in trials[list(best.columns)].itertuples(index=False)}


def test_training_reports(q):
    rt = q("run_training").toPandas()
    assert set(rt["split"]) == {"val", "test"} and len(rt) == 2 * 17
    g = rt.set_index(["split", "metric"])["value"]
    for sp in ("val", "test"):
        assert math.isclose(g[(sp, "gini")], round(2 * g[(sp, "auc_roc")] - 1, 6), abs_tol=2e-6)
    ba = q("before_after_calibration").toPandas()
    assert set(ba["variant"]) == {"raw", "calibrated"} and len(ba) == 6
    ev = q("evaluate_standalone").toPandas()
    assert len(ev) == 17


def test_attribution_and_scoring(q):
    b = q("base_rate").first()["base_value"]
    assert 0 <= b <= 1
    sb = q("score_batch")
    rows = sb.collect()
    assert rows and all(r["risk_tier"] in C.TIER_NAMES for r in rows)
    assert all(r["top_factors"] is None or len(r["top_factors"]) <= C.SHAP_TOP_K for r in rows)
    assert all(r["patient_id"].startswith("batch_") for r in rows)
    assert {r["base_rate"] for r in rows} == {round(b, 4)}
    phi = q("shapley_values").groupBy("encounter_id").agg(F.sum("phi").alias("s"), F.first("expected").alias("e"), F.count("*").alias("n")).collect()
    assert phi and len({r["n"] for r in phi}) == 1 and len({r["e"] for r in phi}) == 1
    lenient = q("score_lenient").toPandas()
    assert lenient["score"].between(0, 1).all() and len(lenient) == len(rows)
    runs = [q("score_stream").collect() for _ in range(2)]
    one, two = (sorted(((r["encounter_id"], r["score"]) for r in run), key=repr) for run in runs)
    full = {r["patient_id"]: r for r in rows}           # a request's answer is the batch's answer
    for r in runs[0]:
        if r["violations"] is None:
            same = full[f"batch_{r['encounter_id']}"]
            assert (r["risk_tier"], r["base_rate"], r["expected"], r["top_factors"]) == (same["risk_tier"], same["base_rate"], same["expected"], same["top_factors"])
    assert one == two and len(one) == len(rows)         # every request once, on every call
    bad = [k for k, s in one if s is None]
    assert bad and {k for k in (r[0] for r in one) if k % 17 == 0} <= set(bad)
    params = q("params_io").toPandas()
    assert set(params["name"]) == {"tier_thresholds", "medians", "selected_features", "flag_percentile", "flag_threshold"}
