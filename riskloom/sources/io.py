"""Sinks and parameter persistence.

Writes go to paths chosen by the caller (on a cluster: shared storage); the
registry's round-trip queries write under the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS_SCHEMA = "name string, key string, value double, text string"


def sink_csv(df: DataFrame, path: str, null_value: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)


def sink_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_json_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long ``(metric, value)`` rounded to 6 dp, one JSON object per line."""
    metrics.select("metric", F.round("value", 6).alias("value")).coalesce(1) \
        .write.mode(mode).json(path)


def read_json_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, value double").json(path)


def save_params(spark: SparkSession, path: str, params: dict, mode: str = "overwrite") -> None:
    """Fitted parameters as rows (name, key, value, text): scalars, maps and lists."""
    rows = []
    for name, v in params.items():
        if isinstance(v, dict):
            rows += [(name, str(k), float(x) if x is not None else None, None) for k, x in v.items()]
        elif isinstance(v, (list, tuple)):
            rows += [(name, str(i), None, str(x)) for i, x in enumerate(v)]
        elif isinstance(v, str):
            rows.append((name, None, None, v))
        else:
            rows.append((name, None, float(v) if v is not None else None, None))
    spark.createDataFrame(rows, PARAMS_SCHEMA).coalesce(1).write.mode(mode).json(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS_SCHEMA).json(path)
