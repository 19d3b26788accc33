"""A training run is read back whole from its folder, and an unfinished one is not seen."""

import os

import pytest
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import model as MD
from riskloom.operators import strata as S
from riskloom.operators import training as TN
from tests.test_model import _data


def test_run_is_read_back_and_unfinished_is_ignored(spark, tmp_path, monkeypatch):
    d, feats, path = _data(spark, 400), ["a", "b", "c"], str(tmp_path / "runs")
    parts = [d.where(F.col("k") % 4 > 1), d.where(F.col("k") % 4 == 1), d.where(F.col("k") % 4 == 0)]
    with pytest.raises(ValueError):
        TN.load_run(spark, path)
    space = dict(C.SEARCH_SPACE, n_estimators=(2, 5), max_depth=(2, 3))
    TN.train(*parts, feats, "y", path, n_trials=2, space=space)
    run = TN.load_run(spark, path)
    trials = run.table("trials")
    best = MD.best_trial(trials).first()
    assert trials.count() == 2 and run.version.meta["val_auc"] == best["val_auc"]
    assert run.version.meta["params"]["learning_rate"] == best["learning_rate"]
    model = run.model()
    assert model.model.stages[-1].getNumTrees == int(best["n_estimators"])
    test = sorted(map(tuple, model.predict_proba(parts[2]).select(F.col("y"), "score").collect()))
    assert test == sorted(map(tuple, run.table("scores").where("split = 'test'").select("label", "score").collect()))
    m = {(r["split"], r["metric"]): r["value"] for r in run.table("metrics").collect()}
    assert m["test", "gini"] == pytest.approx(2 * m["test", "auc_roc"] - 1, abs=2e-6) and len({s for s, _ in m}) == 2
    val = run.table("scores").where("split = 'val'")
    assert run.thresholds() == S.tier_thresholds(val) and run.table("importance").count() == 3
    assert run.table("tier_qa").agg(F.sum("n")).first()[0] == parts[2].count()

    def died(*a, **k):
        raise RuntimeError("died")

    monkeypatch.setattr(TN, "headline_metrics", died)
    with pytest.raises(RuntimeError):
        TN.train(*parts, feats, "y", path, trials=trials)
    assert TN.load_run(spark, path).version == run.version
    assert len([f for f in os.listdir(path) if f.startswith("v")]) == 2        # the unfinished folder lies there, unseen
