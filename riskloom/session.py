"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "riskloom") -> SparkSession:
    """Local/test session; on a cluster use the cluster's own session."""
    b = (SparkSession.builder
         .appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediates.

    ``spark.checkpoint.dir`` names it (on a cluster, a folder that driver and
    executors share); a folder set with ``setCheckpointDir`` counts where the
    setting is absent.  Only a local master, where everything is one machine,
    gets a private folder when both are absent; a cluster without one is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    d = d or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        sc.setCheckpointDir(d)
    return d


#: Rows a file of a wide table whose columns compress well: scans are cut by bytes on disk,
#: so larger files would give a task millions of rows.
FILE_ROWS = 50_000


def written(df: DataFrame, tag: str, file_rows: int = 0) -> DataFrame:
    """``df`` as a table under the shared checkpoint folder: computed once, readable
    by every later job and still there when an executor is lost.  ``file_rows`` bounds the
    rows of a file (0: no bound)."""
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an input that one shuffle partition is laid out for.
PARTITION_ROWS = 500_000
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def follow_rows(spark: SparkSession, rows: int, each: int = PARTITION_ROWS) -> None:
    """Adaptive shuffles start from so many partitions that one holds ``each`` of ``rows`` rows
    on average, and small ones are joined again: with a fixed number the rows and the memory
    of a task would grow with the input.  The number is only ever raised."""
    now = spark.conf.get(_FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions", "200")
    need = -(-rows // each)
    if need > int(now):
        spark.conf.set(_FIRST, str(need))


def scratch_path(spark: SparkSession, name: str) -> str:
    """Path for a written intermediate table under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", name)
