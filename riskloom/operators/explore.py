"""Exploratory aggregates: rates by category, value counts, cardinality, NULL
counts, histograms, correlations, box statistics, column profiles.

Multi-column profiles unpivot with ``explode(array(struct…))`` so every column
is handled by one shuffle instead of one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import safe_corr

from riskloom.functions.exprs import linspace
from riskloom.operators.cleaning import numeric_columns, string_columns


def unpivot(df: DataFrame, cols, keep=(), value_type: str = "string") -> DataFrame:
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                     F.col(c).cast(value_type).alias("value")) for c in cols]))
    return df.select(*keep, s.alias("x")).select(*keep, "x.column", "x.value")


def rate_by_category(df: DataFrame, cols, label: str) -> DataFrame:
    """Positive rate and count per category value of each column, plus the overall rate."""
    long = unpivot(df, cols, keep=(label,))
    g = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"),
                                            F.avg(label).alias("rate"))
    overall = df.agg(F.avg(label).alias("o")).first()["o"]
    return g.select("column", "value", "n", F.round("rate", 6).alias("rate"),
                    F.round(F.lit(overall), 6).alias("overall_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and proportions per value (the total is a collected scalar)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.count()
    return g.select(F.col(col).alias("value"), "count",
                    F.round(F.col("count") / F.lit(total), 6).alias("proportion"))


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, salt_of: str,
                    buckets: int = 64) -> DataFrame:
    """Exact top-k rows per group without one task per group: rank within
    (group, hash bucket of ``salt_of``) first, keep k per bucket, then rank the
    ≤ k·buckets candidates per group.  Adds ``rank`` (1-based)."""
    g = list(group_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_of)), F.lit(buckets)))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order_cols)
    cand = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*g).orderBy(*order_cols)
    return cand.withColumn("rank", F.row_number().over(w2).cast("long")).where(F.col("rank") <= k)


def cardinality_top(df: DataFrame, cols, k: int = 3) -> DataFrame:
    """Distinct count and the k most frequent values (ties by value) per column."""
    long = unpivot(df, cols)
    vc = long.where(F.col("value").isNotNull()).groupBy("column", "value") \
        .agg(F.count(F.lit(1)).alias("n")).cache()
    top = top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("value")], k, salt_of="value")
    uniq = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    return top.join(uniq, "column").select("column", "value", "n", "rank", "n_unique")


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) as (column, nulls)")
    return long.where(F.col("nulls") > 0) if only_positive else long


def histogram(df: DataFrame, cols, bins: int = 30) -> DataFrame:
    """Equal-width histogram per column over its own [min, max] (last bin closed)."""
    r = df.agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    structs = []
    for c in cols:
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        if lo is None:
            continue
        lo, hi = float(lo), float(hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        inner = linspace(lo, hi, bins + 1)[1:-1]
        b = F.least(sum((F.col(c) >= F.lit(e)).cast("int") for e in inner), F.lit(bins - 1))
        structs.append(F.struct(F.lit(c).alias("column"),
                                F.when(F.col(c).isNotNull(), b).alias("bin")))
    long = df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    return long.where(F.col("bin").isNotNull()).groupBy("column", "bin") \
        .agg(F.count(F.lit(1)).alias("count"))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation for every pair below the diagonal (pairwise-complete rows).

    Every row meets every pair, and pairs are groups: one aggregate over all pairs would be
    a generated method that is too big for the JVM to compile."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i)]
    of = lambda k: F.array(*[F.lit(p[k]) for p in pairs])
    values = F.array(*[F.col(c).cast("double") for c in cols])
    long = df.select(values.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"))
    long = long.select("pair", F.get("v", F.get(of(0), F.col("pair"))).alias("x"), F.get("v", F.get(of(1), F.col("pair"))).alias("y"))
    found = long.groupBy("pair").agg(safe_corr("x", "y").alias("corr"))
    names = [(n, cols[i], cols[j]) for n, (i, j) in enumerate(pairs)]
    every = df.sparkSession.createDataFrame(names, "pair int, col_a string, col_b string")
    # one row per pair on both sides
    return every.join(found, "pair", "left").select("col_a", "col_b", F.round("corr", 6).alias("corr"))


def box_stats(df: DataFrame, cols, by: str) -> DataFrame:
    """Quartiles, min/max and 1.5·IQR whiskers per column and class.

    Quartiles are exact grouped order statistics (distributed); the whiskers
    then need one aggregation with the quartiles as per-group literals.
    """
    from riskloom.functions.cumulative import grouped_exact_quantiles
    long = unpivot(df, cols, keep=(by,), value_type="double").where(F.col("value").isNotNull())
    q = grouped_exact_quantiles(long, "value", ["column", by], [0.25, 0.5, 0.75])
    schema = long.select(F.col("column").alias("_qc"), F.col(by).alias("_qb")).schema
    for c in ("_q1", "_q2", "_q3"):
        schema = schema.add(c, "double")
    quart = df.sparkSession.createDataFrame([(*k, *v) for k, v in q.items()], schema)
    long = long.join(quart, (F.col("column") == F.col("_qc")) & F.col(by).eqNullSafe(F.col("_qb")))
    q1, med, q3 = F.col("_q1"), F.col("_q2"), F.col("_q3")
    iqr = q3 - q1
    v = F.col("value")
    w = long.groupBy("column", by).agg(
        F.min(v).alias("min"), F.first(q1).alias("q1"), F.first(med).alias("median"),
        F.first(q3).alias("q3"), F.max(v).alias("max"),
        F.min(F.when(v >= q1 - 1.5 * iqr, v)).alias("whisker_lo"),
        F.max(F.when(v <= q3 + 1.5 * iqr, v)).alias("whisker_hi"))
    return w.select("column", by, *[F.round(c, 6).alias(c) for c in
                                    ("min", "q1", "median", "q3", "max", "whisker_lo", "whisker_hi")])


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, NULLs, distinct non-NULL values, min, max (as text).

    Distinct counts go through one unpivoted (column, value) aggregation, not one
    distinct aggregate per column (which would expand every row per column).
    """
    types = dict(df.dtypes)
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols],
                 *[F.min(c).cast("string").alias(f"lo_{c}") for c in cols],
                 *[F.max(c).cast("string").alias(f"hi_{c}") for c in cols])
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                                     F.col("_rows").alias("rows"), F.col(f"n_{c}").alias("nulls"),
                                     F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"))
                            for c in cols]))
    base = agg.select(s.alias("x")).select("x.*")
    distinct = unpivot(df, cols).where(F.col("value").isNotNull()).distinct() \
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return base.join(distinct, "column", "left") \
        .select("column", "type", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"),
                "min", "max")
