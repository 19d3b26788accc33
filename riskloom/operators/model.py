"""Model fitting with Spark ML: weighted boosted trees, logistic baseline, early
stopping, random search, isotonic calibration, scoring, persistence.

Boosted trees map as: n_estimators → maxIter, learning_rate → stepSize,
max_depth → maxDepth (an error above MLlib's limit of 30), subsample → subsamplingRate,
colsample_bytree → featureSubsetStrategy (fraction), min_child_weight →
minInstancesPerNode, gamma → minInfoGain (times ``GAIN_SCALE``: MLlib's gain is a
variance reduction per row, at most 1); the L1/L2 leaf penalties have no MLlib
counterpart and are not searched.  Class imbalance is a per-row weight (neg/pos on positives).
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import boosting
from riskloom.operators.isotonic import block_ends, pooled_blocks


GAIN_SCALE = 2.0e-4
#: Up to so many rows MLlib's own fit is used: it holds about 300 bytes a row, and where these do not
#: stay in memory every level of every tree reads them from disk again.
MLLIB_ROWS = 1_000_000


def class_ratio(df: DataFrame, label: str) -> float:
    r = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return r["neg"] / r["pos"] if r["pos"] else 1.0


def with_pos_weight(df: DataFrame, label: str, ratio: float, out: str = "_w") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def gbt(features, label: str, params: dict | None = None, weight: str | None = "_w",
        validation: str | None = None, seed: int = C.SEED) -> Pipeline:
    p = dict(C.GBT_DEFAULTS)
    p.update(params or {})
    if int(p["max_depth"]) > 30:
        raise ValueError("max_depth over 30 is beyond MLlib's trees")
    kw = dict(featuresCol="features", labelCol=label, maxIter=int(p["n_estimators"]),
              stepSize=float(p["learning_rate"]), maxDepth=int(p["max_depth"]),
              subsamplingRate=float(p["subsample"]),
              featureSubsetStrategy=str(float(p["colsample_bytree"])), seed=seed)
    if "min_child_weight" in p:
        kw["minInstancesPerNode"] = max(1, int(round(p["min_child_weight"])))
    if "gamma" in p:
        kw["minInfoGain"] = float(p["gamma"]) * GAIN_SCALE
    if weight:
        kw["weightCol"] = weight
    if validation:
        kw["validationIndicatorCol"] = validation
        kw["validationTol"] = float(p.get("validation_tol", 0.01))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                            handleInvalid="keep"),
                            GBTClassifier(**kw)])


def positive_score(model_out: DataFrame, col: str = "probability", out: str = "raw_score") -> DataFrame:
    return model_out.withColumn(out, vector_to_array(F.col(col))[1])


def fit_gbt(train: DataFrame, features, label: str, params: dict | None = None,
            val: DataFrame | None = None) -> PipelineModel:
    if val is None and train.count() > MLLIB_ROWS:
        return fit_blocks(train, features, label, [params])[0]
    ratio = class_ratio(train, label)
    d = with_pos_weight(train, label, ratio)
    if val is not None:
        v = with_pos_weight(val, label, ratio)
        d = d.withColumn("_is_val", F.lit(False)).unionByName(v.withColumn("_is_val", F.lit(True)))
        return gbt(features, label, params, validation="_is_val").fit(d)
    return gbt(features, label, params).fit(d)


def fit_blocks(train: DataFrame, features, label: str, params: list) -> list[PipelineModel]:
    """A model for each of ``params``, all of the same rows, fitted over binned blocks
    (``boosting``); by MLlib's own fit where the rows are not for that."""
    ratio = class_ratio(train, label)
    pipelines = [gbt(features, label, p) for p in params]
    found = boosting.fit_many(train, features, label, ratio, pipelines)
    if found is not None:
        return found
    d = with_pos_weight(train, label, ratio)
    return [p.fit(d) for p in pipelines]


def fit_logistic(train: DataFrame, features, label: str, max_iter: int = 100) -> PipelineModel:
    from riskloom.operators.selection import balanced_weight_expr
    d = train.withColumn("_w", balanced_weight_expr(train, label))
    p = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                         LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w",
                                            maxIter=max_iter)])
    return p.fit(d)


def score(model: PipelineModel, df: DataFrame, out: str = "raw_score") -> DataFrame:
    return positive_score(model.transform(df), out=out).drop("features", "rawPrediction",
                                                            "probability", "prediction")


# ---- isotonic calibration ---------------------------------------------------------------
def fit_isotonic(scored_val: DataFrame, label: str, raw: str = "raw_score") -> IsotonicRegressionModel:
    """Non-decreasing map raw score → probability, fitted on validation scores only: the
    blocks are pooled over score ranges, the stored model is MLlib's over their ends
    (which are monotone already, so nothing is left to pool)."""
    ends = block_ends(pooled_blocks(scored_val, label, raw)).select(F.col("x").alias(raw), F.col("value").alias(label), F.col("weight").alias("_w"))
    return IsotonicRegression(featuresCol=raw, labelCol=label, predictionCol="score", weightCol="_w", isotonic=True).fit(ends)


def calibrate(iso: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    return iso.transform(scored)


@dataclass
class RiskModel:
    """Boosted trees + optional isotonic calibrator; ``predict_proba`` uses the
    calibrated score when present."""
    model: PipelineModel
    features: list
    calibrator: IsotonicRegressionModel | None = None
    meta: dict = field(default_factory=dict)

    def predict_proba(self, df: DataFrame, out: str = "score") -> DataFrame:
        s = score(self.model, df, "raw_score")
        if self.calibrator is None:
            return s.withColumn(out, F.col("raw_score"))
        c = self.calibrator.transform(s)
        return c if out == "score" else c.withColumnRenamed("score", out)

    def score_vectors(self, df: DataFrame) -> DataFrame:
        """``df`` (with a ``features`` vector) with the ``score`` that ``predict_proba`` gives."""
        s = positive_score(self.model.stages[-1].transform(df))
        return s.withColumn("score", F.col("raw_score")) if self.calibrator is None else self.calibrator.transform(s)

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("pred", (F.col("score") >= threshold).cast("int"))

    def importance(self, top: int = 20) -> list[tuple[str, float]]:
        imp = self.model.stages[-1].featureImportances.toArray()
        pairs = sorted(zip(self.features, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))
        return pairs[:top]

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")

    @classmethod
    def load(cls, path: str, features, calibrated: bool = True) -> "RiskModel":
        m = PipelineModel.load(f"{path}/model")
        cal = IsotonicRegressionModel.load(f"{path}/calibrator") if calibrated else None
        return cls(m, list(features), cal)


# ---- random search ------------------------------------------------------------------------
def sample_params(rng: random.Random, space=C.SEARCH_SPACE) -> dict:
    """One draw: ints uniform, rates log-uniform, fractions uniform."""
    import math
    p = {}
    for k, (lo, hi) in space.items():
        if k in ("n_estimators", "max_depth", "min_child_weight"):
            p[k] = rng.randint(int(lo), int(hi))
        elif k == "learning_rate":
            p[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        else:
            p[k] = rng.uniform(lo, hi)
    return p


def hyper_search(train: DataFrame, val: DataFrame, features, label: str, n_trials: int = C.N_TRIALS,
                 seed: int = C.SEED, parallelism: int = 4, space=C.SEARCH_SPACE) -> DataFrame:
    """Seeded random search maximising validation AUC (the trials' trees are grown
    over one binned table, their scores taken by concurrent Spark jobs).

    Returns ``(trial, params…, n_nodes, val_auc)``; the trials table has n_trials rows.
    """
    from riskloom.operators.metrics import auc_table
    rng = random.Random(seed)
    draws = [sample_params(rng, space) for _ in range(n_trials)]
    ratio = class_ratio(train, label)
    grown = boosting.grown_many(train, features, label, ratio, [gbt(features, label, p).getStages()[-1] for p in draws])
    val = val.cache()

    def run(i):
        if grown is None:
            m = gbt(features, label, draws[i]).fit(with_pos_weight(train, label, ratio))
            s, nodes = score(m, val), m.stages[-1].totalNumNodes
        else:
            s, nodes = boosting.with_score(val, features, grown[i], [label]), grown[i].nodes()
        s = s.select(label, "raw_score").cache()
        auc = auc_table(s, "raw_score", label).first()["auc_roc"]
        s.unpersist()
        return nodes, auc

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        res = list(ex.map(run, range(n_trials)))
    val.unpersist()
    rows = [(i, *[float(draws[i][k]) for k in sorted(space)], *res[i]) for i in range(n_trials)]
    schema = "trial int, " + ", ".join(f"{k} double" for k in sorted(space)) + ", n_nodes int, val_auc double"
    return train.sparkSession.createDataFrame(rows, schema)


def search_convergence(trials: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    # trials has n_trials rows: one ordered window over it is bounded by the parameter.
    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.select("trial", "val_auc", F.max("val_auc").over(w).alias("best_so_far"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The row of the best ``val_auc``, of equal ones the first trial."""
    best = F.max_by(F.struct(*[F.col(c) for c in trials.columns]), F.struct("val_auc", -F.col("trial")))
    return trials.agg(best.alias("b")).select("b.*")
