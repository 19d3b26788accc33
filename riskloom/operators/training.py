"""A whole training run as one version of a model folder.

Search → fit with the best parameters → calibrate on validation scores → evaluate →
risk tiers → importance.  Every stage is written to the run's own folder and the next
one reads it back from there; the version's manifest row comes last, so readers see a
complete run or the one before it.  A run that died leaves an ignored folder.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import model as MD
from riskloom.operators import strata as S
from riskloom.operators.metrics import headline_metrics
from riskloom.sources.versioned import Version, latest, publish

#: Trial columns that are no parameters.
_RESULTS = ("trial", "n_nodes", "val_auc")


@dataclass
class TrainedRun:
    """One complete run, as read from its folder."""
    spark: SparkSession
    version: Version

    def table(self, name: str) -> DataFrame:
        """``trials``, ``scores`` (by split), ``metrics``, ``tiers``, ``tier_qa`` or ``importance``."""
        return self.spark.read.parquet(os.path.join(self.version.folder, name))

    def model(self) -> MD.RiskModel:
        return MD.RiskModel.load(os.path.join(self.version.folder, "calibrated"), self.version.meta["features"])

    def thresholds(self) -> dict:
        return self.table("tiers").first().asDict()


def load_run(spark: SparkSession, path: str) -> TrainedRun:
    """The newest complete run."""
    found = latest(spark, path)
    if found is None:
        raise ValueError(f"no complete training run in {path}")
    return TrainedRun(spark, found)


def train(train_rows: DataFrame, val: DataFrame, test: DataFrame, features, label: str, path: str, trials: DataFrame | None = None,
          n_trials: int = C.N_TRIALS, space=C.SEARCH_SPACE, seed: int = C.SEED) -> TrainedRun:
    """Run all stages and publish them; ``trials`` takes the place of a search."""
    spark, names = train_rows.sparkSession, list(features)

    def write(folder: str) -> dict:
        at = lambda name: os.path.join(folder, name)
        back = lambda name: spark.read.parquet(at(name))
        found = trials if trials is not None else MD.hyper_search(train_rows, val, names, label, n_trials=n_trials, space=space, seed=seed)
        found.write.parquet(at("trials"))
        best = MD.best_trial(back("trials")).first().asDict()
        params = {k: v for k, v in best.items() if k not in _RESULTS}
        MD.RiskModel(MD.fit_blocks(train_rows, names, label, [params])[0], names).save(at("raw"))     # the trial's own fit
        raw = MD.RiskModel.load(at("raw"), names, calibrated=False)
        MD.RiskModel(raw.model, names, MD.fit_isotonic(MD.score(raw.model, val), label)).save(at("calibrated"))
        model = MD.RiskModel.load(at("calibrated"), names)
        for name, part in (("val", val), ("test", test)):
            model.predict_proba(part).select(F.col(label).cast("int").alias("label"), "score").write.parquet(at(f"scores/split={name}"))
        scores = lambda name: back("scores").where(F.col("split") == name).select("label", "score")
        for name in ("val", "test"):
            headline_metrics(scores(name)).coalesce(1).write.parquet(at(f"metrics/split={name}"))
        S.thresholds_frame(spark, S.tier_thresholds(scores("val"))).coalesce(1).write.parquet(at("tiers"))
        S.tier_qa(scores("test"), back("tiers").first().asDict()).coalesce(1).write.parquet(at("tier_qa"))
        spark.createDataFrame(model.importance(len(names)), "feature string, importance double").coalesce(1).write.parquet(at("importance"))
        return {"features": names, "label": label, "params": params, "val_auc": best["val_auc"]}

    return TrainedRun(spark, publish(spark, path, write))
