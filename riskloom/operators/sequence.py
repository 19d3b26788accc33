"""Per-entity ordered sequence features that survive a hot entity.

``lead`` and "count of earlier rows" per entity are normally one window
partitioned by the entity; a single entity holding a third of all rows would
then run in a single task.  Here the window is partitioned by
(entity, time chunk) instead, and each chunk learns from a per-(entity, chunk)
totals table — one row per chunk, so at most (time span / chunk width) rows
for even the hottest entity — the offset of earlier chunks and the first
timestamp of the following chunk.  Results equal the single-window version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_sequence(df: DataFrame, key: str, ts: str, tiebreak: str,
                    next_name: str, prior_counts: dict[str, Column],
                    chunk_unit: str = "month") -> DataFrame:
    """Add ``next_name`` (next ``ts`` of the same ``key``) and, per entry of
    ``prior_counts``, the number of strictly earlier rows of the key where the
    condition holds (ordered by ``ts, tiebreak``)."""
    d = df.withColumn("_chunk", F.date_trunc(chunk_unit, F.col(ts)))
    for n, cond in prior_counts.items():
        d = d.withColumn(f"_c_{n}", F.coalesce(cond, F.lit(False)).cast("long"))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tiebreak)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = d.select(
        "*", F.lead(ts).over(w).alias("_next_in_chunk"),
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_l_{n}")
          for n in prior_counts])
    tot = d.groupBy(key, "_chunk").agg(
        F.min(ts).alias("_first"), *[F.sum(f"_c_{n}").alias(f"_t_{n}") for n in prior_counts])
    wt = Window.partitionBy(key).orderBy("_chunk")
    offs = tot.select(
        key, "_chunk", F.lead("_first").over(wt).alias("_next_chunk_first"),
        *[F.coalesce(F.sum(f"_t_{n}").over(wt.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_o_{n}") for n in prior_counts])
    # null-safe: rows without key or time form groups of their own, as in one window.
    offs = offs.withColumnRenamed(key, "_ok").withColumnRenamed("_chunk", "_oc")
    j = local.join(offs, F.col(key).eqNullSafe(F.col("_ok")) & F.col("_chunk").eqNullSafe(F.col("_oc")))
    return j.select(
        *df.columns,
        F.coalesce("_next_in_chunk", "_next_chunk_first").alias(next_name),
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).cast("long").alias(n) for n in prior_counts])
