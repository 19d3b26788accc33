"""Walks through the trees give the sampled attribution of the scored hybrids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import model as MD


@pytest.mark.parametrize("calibrated", [True, False])
def test_same_as_scoring_every_hybrid(spark, calibrated):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 4)).round(1)
    y = (v[:, 0] + v[:, 1] * v[:, 2] + rng.normal(size=300) > 0.5).astype(int)
    feats = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(v, y))], "k long, a double, b double, c double, d double, y int").cache()
    m = MD.fit_gbt(d, feats, "y", dict(n_estimators=12, max_depth=6))
    rm = MD.RiskModel(m, feats, MD.fit_isotonic(MD.score(m, d), "y") if calibrated else None)
    # a key that comes twice, one that is null, a value beyond all thresholds
    rows = d.limit(40).unionByName(d.where("k = 3")).unionByName(d.where("k = 4").withColumn("k", F.lit(None).cast("long"))) \
        .unionByName(d.where("k = 5").withColumn("k", F.lit(900).cast("long")).withColumn("b", F.lit(1e9)))
    bg = X.hash_rank_sample(d, "k", 20)
    got, want = ({(r["k"], r["feature"]): r for r in f.collect()} for f in (
        X.tree_sampling(rows, bg, "k", feats, rm, draws=5), X.shapley_sampling(rows, bg, "k", feats, rm.score_vectors, draws=5)))
    assert got.keys() == want.keys() and len(got) == 41 * 4
    for k, r in want.items():
        assert abs(got[k]["phi"] - r["phi"]) < 1e-9 and (got[k]["feature_no"], got[k]["value"]) == (r["feature_no"], r["value"])


def test_no_hybrid_is_built(spark, monkeypatch):
    """Answers used to score (features + 1) x draws vectors a row."""
    from riskloom.plans import q_monitor as QM
    d = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "encounter_id long, a double, b double, y int").cache()
    m = MD.fit_gbt(d, ["a", "b"], "y", dict(n_estimators=3, max_depth=2))
    rm = MD.RiskModel(m, ["a", "b"], MD.fit_isotonic(MD.score(m, d), "y"))
    monkeypatch.setattr(MD.RiskModel, "score_vectors", lambda *a: pytest.fail("a hybrid was built"))
    out = QM.answers(rm, d.limit(10))(d).collect()
    assert len(out) == 60 and all(abs(sum(f["shap_impact"] for f in r["top_factors"]) + r["expected"] - r["score"]) < 1e-3 for r in out)
