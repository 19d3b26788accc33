"""Distinct counts and heavy hitters from stored, mergeable sketches.

``cardinality_top`` is exact and shuffles every distinct value, which is all of a
column whose values are nearly unique.  Here each part of the input (a day, a load, a
file group) is reduced once to one row a column: its rows and NULLs, a theta
sketch of its values and a frequent-items sketch.  What is shuffled and stored are
sketches of a fixed size, never values; any set of parts is merged later, and a part
that is loaded again replaces its own sketches only.

Error: distinct counts within ``distinct_error`` (one standard error, relative; exact up
to ``2 ** lg_entries`` values), counts of heavy hitters within ``top_error`` times the rows
(exact while a column has at most ``tracked`` values).  Estimates are always taken from
a merge, so merged parts and a sketch built at once agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_ENTRIES = 12
TRACKED = 10_000


def distinct_error(lg_entries: int = LG_ENTRIES) -> float:
    return 1.0 / ((1 << lg_entries) - 1) ** 0.5


def top_error(tracked: int = TRACKED) -> float:
    """A counter's error as a share of all rows, for a table of three quarters' load."""
    table = 1
    while table * 0.75 < tracked:
        table *= 2
    return 3.5 / table


def column_sketches(df: DataFrame, cols, part, lg_entries: int = LG_ENTRIES, tracked: int = TRACKED) -> DataFrame:
    """``part, column, n, nulls, theta, top`` for every part (a column or expression) and column."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("string")
        aggs += [F.count(v).alias(f"n_{i}"), F.count_if(v.isNull()).alias(f"z_{i}"),
                 F.theta_sketch_agg(F.concat(F.lit("="), v), lg_entries).alias(f"h_{i}"),       # a sketch passes over empty strings
                 F.call_function("approx_top_k_accumulate", v, F.lit(tracked)).alias(f"t_{i}")]
    wide = df.groupBy((F.col(part) if isinstance(part, str) else part).alias("part")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"z_{i}").alias("nulls"),
                              F.col(f"h_{i}").alias("theta"), F.col(f"t_{i}").alias("top")) for i, c in enumerate(cols)])
    return wide.select("part", F.explode(rows).alias("s")).select("part", "s.*")


def store(sketches: DataFrame, path: str) -> None:
    """Add or replace the sketches of these parts; those of other parts stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge(sketches: DataFrame, by=("column",), lg_entries: int = LG_ENTRIES, tracked: int = TRACKED) -> DataFrame:
    """One sketch per ``by`` from any number of parts."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.theta_union_agg("theta", lg_entries).alias("theta"),
                                     F.call_function("approx_top_k_combine", F.col("top"), F.lit(tracked)).alias("top"))


def estimates(merged: DataFrame, k: int = 3, tracked: int = TRACKED) -> DataFrame:
    """``column, value, n, rank, n_unique``: the k most frequent values (ties by value) and the
    number of distinct ones.  A column without values has no row, like the exact form; one
    without any frequent value has a single row with a NULL value."""
    items = F.call_function("approx_top_k_estimate", F.col("top"), F.lit(tracked))
    # count descending, value ascending; NULL is an item of its own to the sketch
    order = F.sort_array(F.transform(F.filter(items, lambda s: s["item"].isNotNull()), lambda s: F.struct((-s["count"]).alias("m"), s["item"].alias("value"))))
    rows = merged.where("n > 0").select("column", F.posexplode_outer(F.slice(order, 1, k)).alias("at", "s"), F.theta_sketch_estimate("theta").alias("n_unique"))
    return rows.select("column", F.col("s.value").alias("value"), (-F.col("s.m")).alias("n"), (F.col("at") + 1).cast("int").alias("rank"), "n_unique")
