"""Train-fitted ordinal encoding, median imputation and z-scoring.

Fitted state is the code table (one row per distinct category value, a written
table), medians, means/stds.  Codes are looked up by equi-joins on the value,
planned by the code table's measured size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.cleaning import numeric_columns, string_columns
from riskloom.session import written


def code_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): lexicographic 0-based codes of the non-NULL train values,
    plus one NULL-value row per column whose train data had NULLs.

    The distinct values are dealt into ranges of (column, value); a code is the rank
    inside its range plus the sizes of the column's earlier ranges, so no task sorts
    a whole column's values.
    """
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("x")) \
        .select("x.*").distinct()
    # value order is byte order of UTF-8 = code-point order, as Python's sort.
    dealt = written(long.repartitionByRange("column", F.col("value").asc_nulls_first())
                    .withColumn("_rng", F.spark_partition_id()), "codes")
    vals = dealt.where(F.col("value").isNotNull())
    w = Window.partitionBy("column", "_rng").orderBy("value")
    # one row per (column, range)
    before = Window.partitionBy("column").orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offs = vals.groupBy("column", "_rng").agg(F.count(F.lit(1)).alias("_n")) \
        .select("column", "_rng", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    coded = vals.withColumn("_r", F.row_number().over(w) - 1).join(offs, ["column", "_rng"]) \
        .select("column", "value", (F.col("_r") + F.col("_off")).cast("int").alias("code"))
    return coded.unionByName(dealt.where(F.col("value").isNull())
                             .select("column", "value", F.lit(None).cast("int").alias("code")))


@dataclass
class OrdinalModel:
    cols: list[str]
    table: DataFrame | None = None
    null_cols: tuple = ()              # columns whose train data had NULLs

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            m = self.table.where((F.col("column") == c) & F.col("value").isNotNull()) \
                .select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            nul = F.lit(None).cast("double") if c in self.null_cols else F.lit(-1.0)
            out = out.join(m, out[c] == m["_v"], "left") \
                .withColumn(c, F.when(F.col(c).isNull(), nul).otherwise(
                    F.coalesce(F.col("_code").cast("double"), F.lit(-1.0)))).drop("_v", "_code")
        return out


class OrdinalEncoder:
    def __init__(self, cols: list[str] | None = None):
        self.cols = cols

    def fit(self, train: DataFrame) -> OrdinalModel:
        cols = self.cols if self.cols is not None else string_columns(train)
        if not cols:
            return OrdinalModel([])
        t = written(code_table(train, cols), "code-table")
        nulls = t.where(F.col("value").isNull()).select("column").collect()    # at most one row a column
        return OrdinalModel(cols, t, tuple(r["column"] for r in nulls))


@dataclass
class MedianModel:
    medians: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {c: v for c, v in self.medians.items() if c in df.columns and v is not None}
        return df.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill
                           else F.col(c) for c in df.columns])


class MedianImputer:
    """Exact (linear-interpolated) medians of every numeric column."""

    def __init__(self, cols: list[str] | None = None, exclude=()):
        self.cols = cols
        self.exclude = exclude

    def fit(self, train: DataFrame) -> MedianModel:
        cols = self.cols if self.cols is not None else numeric_columns(train, self.exclude)
        if not cols:
            return MedianModel({})
        # exact medians without one buffer per column: unpivot to (column, value),
        # then grouped distributed order statistics.
        from riskloom.functions.cumulative import grouped_exact_quantiles
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in cols])).alias("x")).select("x.*")
        q = grouped_exact_quantiles(long, "value", ["column"], [0.5])
        return MedianModel({c: (q[(c,)][0] if (c,) in q else None) for c in cols})


@dataclass
class ScalerModel:
    stats: dict

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.stats:
                mu, sd = self.stats[c]
                sd = sd if sd else 1.0   # constant column: centred only
                out.append(((F.col(c) - F.lit(mu)) / F.lit(sd)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


class Standardiser:
    """z-score with the population standard deviation (one aggregation)."""

    def __init__(self, cols: list[str]):
        self.cols = cols

    def fit(self, df: DataFrame) -> ScalerModel:
        r = df.agg(*[x for c in self.cols for x in
                     (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        return ScalerModel({c: (r[f"m_{c}"], r[f"s_{c}"]) for c in self.cols})
