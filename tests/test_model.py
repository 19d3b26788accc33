"""Model layer invariants: isotonic monotone, Shapley additivity, search, persistence."""

import os
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import explain as X
from riskloom.operators import model as MD


def _data(spark, n=400):
    rows = []
    for i in range(n):
        a, b, c = (i * 7) % 11, (i * 13) % 5, (i * 3) % 7
        y = 1 if (a + 2 * b + (i % 4 == 0)) > 10 else 0
        rows.append((i, float(a), float(b), float(c), y))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int")


def test_gbt_calibration_monotone(spark):
    d = _data(spark)
    m = MD.fit_gbt(d, ["a", "b", "c"], "y", dict(n_estimators=5, max_depth=3))
    s = MD.score(m, d)
    iso = MD.fit_isotonic(s, "y")
    out = iso.transform(s).select("raw_score", "score").toPandas().sort_values("raw_score")
    assert out["score"].is_monotonic_increasing
    rm = MD.RiskModel(m, ["a", "b", "c"], iso)
    assert rm.predict_proba(d).where(F.col("score") < 0).count() == 0
    assert len(rm.importance(2)) == 2


def test_shapley_additivity(spark):
    d = _data(spark, 200)
    feats = ["a", "b", "c"]
    m = MD.fit_gbt(d, feats, "y", dict(n_estimators=5, max_depth=3))
    gbt = m.stages[-1]

    def score_fn(df):
        return gbt.transform(df).withColumn("score", vector_to_array("probability")[1])

    ex = X.hash_rank_sample(d, "k", 5)
    bg = X.hash_rank_sample(d, "k", 30, seed=7)
    draws = 6
    phi = X.shapley_sampling(ex, bg, "k", feats, score_fn, draws=draws)
    sums = {r["k"]: r["s"] for r in phi.groupBy("k").agg(F.sum("phi").alias("s")).collect()}
    # Σφ = f(x) − mean over the draws of f(background draw)
    fx = {r["k"]: r["raw_score"] for r in MD.score(m, ex).collect()}
    bgp = bg.select(F.array(*[F.col(c) for c in feats]).alias("b"))
    assert len(sums) == 5
    for k, s in sums.items():
        assert abs(s - fx[k]) <= 1.0 + 1e-9          # bounded by the score range
    # exact identity against the per-draw background rows
    from pyspark.sql import Window
    w = Window.orderBy(F.md5(F.to_json(F.col("b"))))
    bgn = bgp.select("b", (F.row_number().over(w) - 1).alias("bg_id"))
    n_bg = bgn.count()
    draws_df = ex.select("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("kk")) \
        .withColumn("bg_id", F.pmod(F.xxhash64(F.col("k"), F.col("kk"), F.lit(42)), F.lit(n_bg)).cast("int")) \
        .join(bgn, "bg_id")
    from pyspark.ml.functions import array_to_vector
    sb = score_fn(draws_df.withColumn("features", array_to_vector("b"))) \
        .groupBy("k").agg(F.avg("score").alias("fb"))
    for r in sb.collect():
        assert abs(sums[r["k"]] - (fx[r["k"]] - r["fb"])) < 1e-9


def test_hyper_search_and_convergence(spark):
    d = _data(spark, 300)
    tr, va = d.where(F.col("k") % 5 != 0), d.where(F.col("k") % 5 == 0)
    space = dict(C.SEARCH_SPACE, n_estimators=(2, 6), max_depth=(2, 4))
    trials = MD.hyper_search(tr, va, ["a", "b", "c"], "y", n_trials=3, space=space).cache()
    rows = trials.collect()
    assert len(rows) == 3 and len({r["n_estimators"] for r in rows}) > 1 and len({r["val_auc"] for r in rows}) > 1
    conv = MD.search_convergence(trials).toPandas().sort_values("trial")
    assert conv["best_so_far"].is_monotonic_increasing
    best = MD.best_trial(trials).first()
    assert best["val_auc"] == conv["val_auc"].max() > 0.6
    assert best["n_nodes"] > best["n_estimators"]            # the trees split
    with pytest.raises(ValueError):
        MD.fit_gbt(tr, ["a"], "y", dict(max_depth=31))


def test_best_trial_takes_the_first_of_equals(spark):
    t = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 0.7), (2, 3.0, 0.7)], "trial int, p double, val_auc double")
    assert tuple(MD.best_trial(t).first()) == (1, 2.0, 0.7)


def test_score_batch_adds_up(spark):
    """Score = expected value over the row's draws + its factors, by the one calibrated score function."""
    d = _data(spark, 200)
    feats = ["a", "b", "c"]
    m = MD.fit_gbt(d, feats, "y", dict(n_estimators=4, max_depth=3))
    rm = MD.RiskModel(m, feats, MD.fit_isotonic(MD.score(m, d), "y"))
    bg = X.hash_rank_sample(d, "k", 1)                  # one background row: every draw starts from it
    phi = X.shapley_sampling(d.limit(10), bg, "k", feats, rm.score_vectors, draws=2)
    base = X.base_rate(rm.predict_proba, bg)
    fx = {r["k"]: r["score"] for r in rm.predict_proba(d).collect()}
    got = phi.groupBy("k").agg(F.sum("phi").alias("s")).collect()
    assert len(got) == 10 and all(abs(base + r["s"] - fx[r["k"]]) < 1e-9 for r in got)


def test_save_load_roundtrip(spark):
    d = _data(spark, 200)
    m = MD.fit_gbt(d, ["a", "b", "c"], "y", dict(n_estimators=3, max_depth=2))
    iso = MD.fit_isotonic(MD.score(m, d), "y")
    rm = MD.RiskModel(m, ["a", "b", "c"], iso)
    path = os.path.join(tempfile.mkdtemp(prefix="riskloom-model-"), "m")
    rm.save(path)
    back = MD.RiskModel.load(path, ["a", "b", "c"])
    a = rm.predict_proba(d).select("k", F.col("score").alias("s1"))
    b = back.predict_proba(d).select("k", F.col("score").alias("s2"))
    assert a.join(b, "k").where(F.col("s1") != F.col("s2")).count() == 0
