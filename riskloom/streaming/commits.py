"""Tables written batch by batch, visible once their batch is committed.

Every micro-batch writes folders of its own, ``<table>/batch=N``, and then one row with
its number into ``commits``.  Readers join with the commits, so a batch that died half
way is not seen; a batch that runs again after its commit is skipped, one that runs
again before it overwrites its own folders.  Either way a replay adds nothing.

:func:`write_changes` and :func:`current` keep a keyed table this way: a batch holds the
new rows of the keys it changed, a key's newest row counts.  Every ``COMPACT`` batches
the current rows are published as a version, from where reading starts.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.versioned import latest, publish

COMPACT = 50


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Numbers of the committed batches."""
    schema = "batch long"
    try:
        return spark.read.schema(schema).parquet(os.path.join(out, "commits")).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def once(spark: SparkSession, out: str, batch_id: int, write: Callable[[], None]) -> bool:
    """Run ``write`` and commit the batch, unless it is committed already."""
    if not committed(spark, out).where(F.col("batch") == batch_id).isEmpty():
        return False
    write()
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(os.path.join(out, "commits"))
    return True


def write_batch(rows: DataFrame, out: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(os.path.join(out, table, f"batch={batch_id}"))


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    """All rows of committed batches, with their ``batch``."""
    rows = spark.read.parquet(os.path.join(out, table))
    return rows.withColumn("batch", F.col("batch").cast("long")).join(committed(spark, out), "batch", "left_semi")


def write_changes(rows: DataFrame, out: str, keys: list[str], batch_id: int, compact: int = COMPACT) -> bool:
    """One batch of upserts: ``rows`` replace the rows of their keys."""
    spark = rows.sparkSession
    done = once(spark, out, batch_id, lambda: write_batch(rows, out, "changes", batch_id))
    if done and (batch_id + 1) % compact == 0:
        publish(spark, os.path.join(out, "compacted"), lambda folder: current(spark, out, keys).write.parquet(folder) or {"batch": batch_id})
    return done


def current(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of every key."""
    base = latest(spark, os.path.join(out, "compacted"))
    rows = read(spark, out, "changes")
    if base is not None:
        rows = rows.where(F.col("batch") > base.meta["batch"]).unionByName(spark.read.parquet(base.folder).withColumn("batch", F.lit(-1).cast("long")))
    own = [c for c in rows.columns if c not in ("batch", *keys)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("row"))
    return newest.select(*keys, "row.*")
