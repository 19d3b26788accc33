"""Feature pipeline driver: clean → split → engineer → encode → impute.

Every fit runs on the train split only (the default); ``per_split=True``
refits the feature parameters per split like the original pipeline.  The
result is one DataFrame with ``split`` and ``label`` columns that can be
written partitioned by split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators.cleaning import Cleaner, numeric_columns, string_columns
from riskloom.operators.encode import MedianImputer, OrdinalEncoder
from riskloom.operators.features import FeatureEngineer
from riskloom.operators.split import stratified_split
from riskloom.session import FILE_ROWS, written

KEY = "encounter_id"


@dataclass
class PipelineResult:
    data: DataFrame
    feature_names: list
    categorical: list
    cleaner: Cleaner
    medians: dict


def run_feature_pipeline(raw: DataFrame, key: str = KEY, label: str = C.LABEL_COL,
                         per_split: bool = False, seed: int = C.SEED) -> PipelineResult:
    cleaner = Cleaner(key=key)
    c = cleaner.fit_transform(raw)
    s = stratified_split(c, key, label, seed=seed)     # reads the cleaner's cached input
    train = s.where(F.col("split") == "train")
    fe = FeatureEngineer()
    if per_split:
        f = fe.fit_transform_per_split(s)
    else:
        f = fe.fit(train).transform(s)
    f = written(f, "features", FILE_ROWS)         # fits and transforms below read it; the derived input is done with
    cleaner.release()
    ftrain = f.where(F.col("split") == "train")
    cats = [x for x in string_columns(f) if x != "split"]
    enc = OrdinalEncoder(cats).fit(ftrain)
    e = written(enc.transform(f), "encoded", FILE_ROWS)
    etrain = e.where(F.col("split") == "train")
    nums = [x for x in numeric_columns(e) if x not in (key, label)]
    imp = MedianImputer(nums).fit(etrain)
    out = imp.transform(e)
    out = out.select(key, "split", label, *[F.col(x).cast("double").alias(x) for x in nums])
    return PipelineResult(out, nums, cats, cleaner, imp.medians)
