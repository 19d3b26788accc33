"""The fit over binned blocks: MLlib's trees, whichever way the sums are taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import boosting as B
from riskloom.operators import model as MD

FEATURES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=600), rng.integers(0, 7, 600), rng.integers(0, 90, 600) / 3.0
    y = (a + (b > 3) + rng.normal(size=600) > 0.6).astype(int)
    data = [(i, float(a[i]), float(b[i]), float(c[i]), 1.0, int(y[i])) for i in range(600)]
    return spark.createDataFrame(data, "k long, a double, b double, c double, same double, y int").coalesce(1).cache()


def _splits(model):
    return [x.strip() for x in model.stages[-1].toDebugString.split("\n") if "feature" in x and x.strip()[:2] in ("If", "El")]


def _scores(model, df):
    return {r["k"]: r["raw_score"] for r in MD.score(model, df).collect()}


PARAMS = [dict(n_estimators=3, max_depth=3), dict(n_estimators=4, max_depth=5, subsample=1.0, colsample_bytree=0.5, min_child_weight=9, gamma=3.0)]


@pytest.mark.parametrize("params", PARAMS)
def test_trees_are_mllibs(rows, params):
    ratio = MD.class_ratio(rows, "y")
    theirs = MD.gbt(FEATURES, "y", params).fit(MD.with_pos_weight(rows, "y", ratio))
    ours = MD.fit_blocks(rows, FEATURES, "y", [params])[0]
    assert _splits(ours) == _splits(theirs)
    assert ours.stages[-1].totalNumNodes == theirs.stages[-1].totalNumNodes
    assert list(ours.stages[-1].treeWeights) == list(theirs.stages[-1].treeWeights)
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray())
    a, b = _scores(theirs, rows), _scores(ours, rows)
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_large_inputs_take_the_blocks(rows, monkeypatch):
    parts = rows.repartition(3, "k").cache()
    here = MD.fit_blocks(parts, FEATURES, "y", PARAMS[:1])[0]
    monkeypatch.setattr(MD, "MLLIB_ROWS", 100)
    monkeypatch.setattr(B, "LOCAL_ROWS", 100)
    monkeypatch.setattr(B, "ROWS", 70)                  # several blocks a task
    monkeypatch.setattr(B, "RESTART", 2)
    monkeypatch.setattr(MD.Pipeline, "fit", lambda *a: pytest.fail("MLlib's fit"))
    over = MD.fit_gbt(parts, FEATURES, "y", PARAMS[0])
    monkeypatch.setattr(B, "SENT", 10)                  # sums by a shuffle, no parents kept
    shuffled = MD.fit_gbt(parts, FEATURES, "y", PARAMS[0])
    assert _splits(here) == _splits(over) == _splits(shuffled)


def test_uniforms_follow_places(spark):
    whole = B.uniforms(43, 0, 500)
    assert np.array_equal(whole[123:400], B.uniforms(43, 123, 277))
    assert 0.4 < whole.mean() < 0.6 and whole.min() >= 0 and whole.max() < 1


def test_holes_are_left_to_mllib(rows):
    holes = rows.withColumn("a", F.when(F.col("k") % 9 != 0, F.col("a")))
    assert B.table(holes, FEATURES, "y", 1.0, 32, 42) is None


real = MD.hyper_search


def test_search_is_whole(spark, rows):
    """The registered search draws all trials from the whole space; ``spark.riskloom.trees`` sets only the tree count."""
    import inspect

    from riskloom.plans import q_model as Q
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Q, "input_key", lambda spark, sf_dir, *settings: repr(settings))
        m.setattr(Q, "_splits", lambda spark, sf_dir: (rows, rows, rows, FEATURES))
        m.setattr(Q, "_MADE", {})
        m.setattr(Q, "scratch_path", lambda spark, name: pytest.fail("written") if seen else "unused")
        m.setattr(MD, "hyper_search", lambda *a, **k: seen.update(inspect.signature(real).bind(*a, **k).arguments) or (_ for _ in ()).throw(StopIteration))
        with pytest.raises(StopIteration):
            Q.search_trials(spark, "unused")
    assert seen.get("n_trials", C.N_TRIALS) == 50 and seen.get("space", C.SEARCH_SPACE) == C.SEARCH_SPACE


def test_trials_are_scored_as_their_models(rows):
    ratio = MD.class_ratio(rows, "y")
    pipeline = MD.gbt(FEATURES, "y", PARAMS[1])
    grown = B.grown_many(rows, FEATURES, "y", ratio, [pipeline.getStages()[-1]])[0]
    model = B.fit_many(rows, FEATURES, "y", ratio, [pipeline])[0]
    assert grown.nodes() == model.stages[-1].totalNumNodes
    a, b = _scores(model, rows), {r["k"]: r["raw_score"] for r in B.with_score(rows, FEATURES, grown, ["k"]).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12
