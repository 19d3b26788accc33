"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir
from riskloom.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the documents table, a null text as the empty text."""
    return texts(read_table(spark, sf_dir, "documents"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, and
    still there when an executor is lost."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "llm", f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python workers in batches of ``rows`` rows, which bounds what
    a worker and the JVM hold of them at a time.  A session that has set a batch size
    of its own (other than Spark's 10000) keeps it."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def release_memory() -> None:
    """Give what a Python worker has freed back to the machine: workers live on from
    task to task, and their allocators would keep it."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:      # a C library without it
        pass


def int_array(values, kind: str = "int") -> Column:
    """A constant array column (folded by the optimiser); entries may be null."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").cast(f"array<{kind}>")


def hex16(col) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def nearest_ids(df: DataFrame, cls: str, n: int) -> DataFrame:
    """The ``n`` rows of class column value ``cls`` that come first by hashed id."""
    return df.filter(cls).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def ordinals(df: DataFrame, groups: list[str], order: list, tag: str) -> DataFrame:
    """``df`` with ``pos``, a row's place (from 0) among the rows of its ``groups`` values
    in ``order``, and ``total``, their number.  Rows are sorted over ranges of (groups,
    order), so a large group lies in many tasks; rows equal in all of ``order`` are told
    apart by a number, so they can be split too.  A null is a value.  ``df`` must not
    have columns ``pos``, ``total``, ``tie``, ``at`` or ``range``."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie")).drop("tie")
    kept = written(ranged.withColumn("at", F.monotonically_increasing_id())
                   .withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), tag)
    per = kept.groupBy(*groups, "range").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(g).alias(f"{g}_of") for g in groups], F.col("range").alias("range_of"),
                     (before - F.col("lo")).alias("shift"), F.sum("n").over(whole).alias("total"))
    per = written(per, f"{tag}-ranges")
    same = kept["range"] == per["range_of"]
    for g in groups:
        same = same & kept[g].eqNullSafe(per[f"{g}_of"])
    return kept.join(per, same).select(*df.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")
