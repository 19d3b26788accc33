"""Cleaning: sentinel → NULL, binary target, configured/high-missing/constant
column drops, NULL-row drop, feature projection.

Column decisions come from one aggregation over all columns (a single pass,
one row back to the driver — a parameter list bounded by the column count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom import config as C
from riskloom.functions import exprs as X


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def sentinel_to_null(df: DataFrame, token: str = "?") -> DataFrame:
    strs = set(string_columns(df))
    return df.select(*[X.sentinel_null(c, token).alias(c) if c in strs else F.col(c)
                       for c in df.columns])


def with_binary_target(df: DataFrame, target=C.TARGET_COL, out=C.LABEL_COL,
                       positive=C.POSITIVE_CLASS) -> DataFrame:
    return df.withColumn(out, X.binary_target(target, positive))


def drop_columns(df: DataFrame, cols=C.DROP_COLUMNS, keep=()) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns and c not in keep])


def missing_profile(df: DataFrame, exclude=()) -> DataFrame:
    """(column, missing_pct) for every column, one pass."""
    cols = [c for c in df.columns if c not in exclude]
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column, missing_pct)")


def high_missing_columns(df: DataFrame, threshold=C.HIGH_MISSING_PCT, exclude=()) -> list[str]:
    prof = missing_profile(df, exclude).where(F.col("missing_pct") > threshold)
    return [r["column"] for r in prof.collect()]


def constant_profile(df: DataFrame, exclude=(), max_missing: float | None = None) -> DataFrame:
    """(column, is_constant): at most one distinct non-NULL value.

    Exact without a distinct-count shuffle: a column is constant iff min = max
    over its non-NULL values (or it has none).  Columns with more than ``max_missing``
    percent NULLs are left out, found in the same pass.
    """
    cols = [c for c in df.columns if c not in exclude]
    row = df.agg(*[F.struct(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("is_constant"),
                            (F.avg(F.col(c).isNull().cast("double")) * 100).alias("missing_pct")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    prof = row.selectExpr(f"stack({len(cols)}, {stack}) as (column, p)")
    if max_missing is not None:
        prof = prof.where(~F.coalesce(F.col("p.missing_pct") > max_missing, F.lit(False)))
    return prof.select("column", "p.is_constant")


def constant_columns(df: DataFrame, exclude=()) -> list[str]:
    return [r["column"] for r in constant_profile(df, exclude).where("is_constant").collect()]


class Cleaner:
    """The five cleaning steps in order; ``key`` is carried, never a feature."""

    def __init__(self, cfg=C, key: str | None = "encounter_id", cache_input: bool = True):
        self.cfg = cfg
        self.key = key
        self.cache_input = cache_input
        self._cached: DataFrame | None = None
        self.dropped_missing: list[str] = []
        self.dropped_constant: list[str] = []

    def release(self) -> None:
        """Drop the cached input once what reads it has been written."""
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    def fit_transform(self, df: DataFrame) -> DataFrame:
        keep = (self.key,) if self.key else ()
        d = sentinel_to_null(df)
        d = with_binary_target(d, self.cfg.TARGET_COL, self.cfg.LABEL_COL, self.cfg.POSITIVE_CLASS)
        d = drop_columns(d, self.cfg.DROP_COLUMNS, keep=keep)
        if self.cache_input:
            # the decision pass and every later pass of a pipeline read d: derive it once
            # (memory and disk; recomputed from lineage if an executor is lost).
            d = self._cached = d.cache()
        # Both decisions from one aggregation pass: a column's min/max does not depend
        # on which other columns are dropped, so "constant among the survivors of the
        # missing-% drop" needs no second pass.
        cols = [c for c in d.columns if c not in keep]
        r = d.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"m_{c}") for c in cols],
                  *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"k_{c}") for c in cols]).first()
        self.dropped_missing = [c for c in cols if r[f"m_{c}"] > self.cfg.HIGH_MISSING_PCT]
        self.dropped_constant = [c for c in cols if c not in self.dropped_missing and r[f"k_{c}"]]
        return d.drop(*self.dropped_missing, *self.dropped_constant)


def clean(df: DataFrame, key: str | None = "encounter_id") -> DataFrame:
    return Cleaner(key=key).fit_transform(df)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def select_features(df: DataFrame, features, keep=()) -> DataFrame:
    return df.select(*keep, *[c for c in features if c in df.columns and c not in keep])
