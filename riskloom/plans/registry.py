"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full; oracle SQL for the same names lives in ``riskloom.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing the modules registers their queries.
    from riskloom.plans import q_quality, q_features, q_metrics, q_strata  # noqa: F401
    from riskloom.plans import q_explore, q_model, q_explain, q_monitor, q_io  # noqa: F401
    return dict(QUERIES)
