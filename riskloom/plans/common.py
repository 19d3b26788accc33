"""Shared derived inputs for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators.cleaning import Cleaner
from riskloom.operators.features import FeatureEngineer
from riskloom.sources.encounters import encounters


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 dp (oracle comparisons)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cleaner(key="encounter_id").fit_transform(encounters(spark, sf_dir))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(spark, sf_dir)          # the cleaner caches its input: fit and transform share it
    return FeatureEngineer().fit(c).transform(c)


LABEL = C.LABEL_COL
