"""Distributed running sums and exact quantiles.

A window with ``orderBy`` but no ``partitionBy`` pulls every row into one task.
``prefix_sums`` instead cuts the ordered domain into contiguous ranges (edges
from ``percentile_approx``, a bounded parameter list), runs the running-sum
window per range in parallel, and adds each range's offset from a per-range
totals table whose size is the number of ranges (broadcast: bounded by the
parameter, not by the data).

``exact_quantiles`` gives numpy's default (linear interpolation) percentiles
without holding a column's values in one buffer: distinct values with counts,
prefix counts, then pick the order statistics that the interpolation needs.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import written


def _n_ranges(df: DataFrame, n_ranges: int | None) -> int:
    if n_ranges:
        return n_ranges
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def range_bucket(df: DataFrame, order_col: str, n_ranges: int | None = None,
                 out: str = "_rng") -> DataFrame:
    """Add a contiguous range id (0..k-1) over ``order_col`` (numeric, no NULLs)."""
    k = _n_ranges(df, n_ranges)
    if k <= 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / k for i in range(1, k)]
    row = df.select(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000)
                    .alias("e")).first()
    edges = sorted(set(e for e in (row["e"] or []) if e is not None and not math.isnan(e)))
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf] + edges + [math.inf]
    tmp = "_rng_src"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, F.col(order_col).cast("double")))
            .drop(tmp).withColumn(out, F.col(out).cast("int")))


def prefix_sums(df: DataFrame, order_col: str, values: dict[str, Column | str],
                descending: bool = False, n_ranges: int | None = None,
                group_cols: list[str] | tuple = ()) -> DataFrame:
    """Running (inclusive) sums of ``values`` along ``order_col`` within each group.

    ``order_col`` must be unique per row within a group (aggregate to distinct
    keys first).  Range edges are global, so a hot group is also spread over
    all ranges.  Output keeps the input columns and adds one column per key of
    ``values``.
    """
    g = list(group_cols)
    vals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    # the input is a distinct-key table read by two jobs (range edges, running sums):
    # written so the upstream aggregation runs once and nothing stays cached.
    d = written(df.select("*", *[v.alias(f"_v_{k}") for k, v in vals.items()]), "prefix")
    d = range_bucket(d, order_col, n_ranges)
    okey = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*g, "_rng").orderBy(okey).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(f"_v_{k}").over(w).alias(f"_l_{k}") for k in vals])
    tot = d.groupBy(*g, "_rng").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in vals])
    rng = F.col("_rng").desc() if descending else F.col("_rng").asc()
    wt = (Window.partitionBy(*g) if g else Window).orderBy(rng) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, "_rng", *[F.coalesce(F.sum(f"_t_{k}").over(wt), F.lit(0))
                                    .alias(f"_o_{k}") for k in vals])
    # offs has one row per (group, range): ranges are a parameter, so without
    # groups it is tiny and broadcast; with groups AQE sizes the join itself.
    # A NULL group is a group.
    offs = offs.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_rng").alias("_orng"), *[f"_o_{k}" for k in vals])
    same = F.col("_rng") == F.col("_orng")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    j = local.join(offs if g else F.broadcast(offs), same)
    return j.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in vals])


def value_counts_table(df: DataFrame, c: str, weight: Column | None = None) -> DataFrame:
    """Distinct non-null values of ``c`` with their row counts (map-side combined)."""
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(agg.alias("_cnt"))


def exact_quantiles_from_counts(counts: DataFrame, c: str, probs: list[float],
                                cnt: str = "_cnt", n_ranges: int | None = None) -> list[float | None]:
    """Linear-interpolated quantiles from a (value, count) table."""
    counts = counts.cache()
    try:
        n = counts.agg(F.sum(cnt).alias("n")).first()["n"] or 0
        if n == 0:
            return [None for _ in probs]
        need = {}
        for p in probs:
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            need[p] = (h, lo, hi)
        positions = sorted({x for _, lo, hi in need.values() for x in (lo, hi)})
        ps = prefix_sums(counts, c, {"_cum": F.col(cnt)}, n_ranges=n_ranges)
        cond = None
        for k in positions:
            ck = (F.col("_cum") - F.col(cnt) <= k) & (F.col("_cum") > k)
            cond = ck if cond is None else (cond | ck)
        rows = ps.where(cond).select(c, cnt, "_cum").collect()
    finally:
        counts.unpersist()
    at = {}
    for r in rows:
        start = r["_cum"] - r[cnt]
        for k in positions:
            if start <= k < r["_cum"]:
                at[k] = float(r[c])
    out = []
    for p in probs:
        h, lo, hi = need[p]
        out.append(lerp(at[lo], at[hi], h - lo))
    return out


def lerp(a: float, b: float, t: float) -> float:
    """numpy's percentile interpolation (symmetric form for t >= 0.5)."""
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


def exact_quantiles(df: DataFrame, c: str, probs: list[float],
                    n_ranges: int | None = None) -> list[float | None]:
    """numpy-default percentiles (linear) of a column, NULLs ignored."""
    return exact_quantiles_from_counts(value_counts_table(df, c), c, probs, n_ranges=n_ranges)


def grouped_exact_quantiles(df: DataFrame, value_col: str, group_cols, probs: list[float],
                            n_ranges: int | None = None) -> dict:
    """Linear-interpolated quantiles of ``value_col`` per group, fully distributed.

    (group, value) counts → per-group sizes (one row per group) → grouped prefix
    counts → the rows covering each needed order statistic, found by an equi-join
    on the group with the (group, position) targets (a table of groups × 2·|probs|
    rows) and a range filter.  Returns {group tuple: [quantile per prob]}.
    """
    g = list(group_cols)
    counts = df.where(F.col(value_col).isNotNull()) \
        .groupBy(*g, F.col(value_col).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_cnt")).cache()
    try:
        sizes = {tuple(r[c] for c in g): r["_n"]
                 for r in counts.groupBy(*g).agg(F.sum("_cnt").alias("_n")).collect()}
        need, targets = {}, []
        for grp, n in sizes.items():
            for p in probs:
                h = (n - 1) * p
                lo, hi = math.floor(h), math.ceil(h)
                need[(grp, p)] = (h, lo, hi)
                targets += [(*grp, lo), (*grp, hi)]
        if not targets:
            return {}
        spark = df.sparkSession
        schema = counts.select(*g).schema.add("_k", "long")
        tdf = spark.createDataFrame(sorted(set(targets), key=repr), schema)
        ps = prefix_sums(counts, "_v", {"_cum": F.col("_cnt")}, n_ranges=n_ranges, group_cols=g)
        if not g:   # one group: the positions become a literal filter instead of a join
            ks = sorted({k for (_, k) in [((), t[-1]) for t in targets]})
            cond = None
            for k in ks:
                c = (F.col("_cum") - F.col("_cnt") <= k) & (F.col("_cum") > k)
                cond = c if cond is None else (cond | c)
            hit = ps.where(cond).select("*", *[F.lit(None).cast("long").alias("_k")])
            rows_any = hit.select("_v", "_cnt", "_cum").collect()
            rows = []
            for r in rows_any:
                for k in ks:
                    if r["_cum"] - r["_cnt"] <= k < r["_cum"]:
                        rows.append({"_k": k, "_v": r["_v"]})
            at = {((), r["_k"]): r["_v"] for r in rows}
            return {(): [lerp(at[((), need[((), p)][1])], at[((), need[((), p)][2])],
                              need[((), p)][0] - need[((), p)][1]) for p in probs]}
        tdf = tdf.withColumnsRenamed({c: f"_t_{c}" for c in g})
        same = F.lit(True)
        for c in g:
            same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        hit = ps.join(tdf, same)
        rows = hit.where((F.col("_cum") - F.col("_cnt") <= F.col("_k")) & (F.col("_cum") > F.col("_k"))) \
            .select(*g, "_k", "_v").collect()
    finally:
        counts.unpersist()
    at = {(tuple(r[c] for c in g), r["_k"]): r["_v"] for r in rows}
    out = {}
    for grp in sizes:
        out[grp] = [lerp(at[(grp, need[(grp, p)][1])], at[(grp, need[(grp, p)][2])],
                         need[(grp, p)][0] - need[(grp, p)][1]) for p in probs]
    return out


def ranged(df: DataFrame, keys: list, tag: str) -> DataFrame:
    """``df`` sorted by ``keys`` over ranges, written, with each row's ``range`` and place
    ``at`` in it.  Rows with equal keys are told apart by a number, so a hot key lies in
    several ranges."""
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie")).drop("tie")
    number = F.monotonically_increasing_id()
    return written(rows.withColumn("at", number).withColumn("range", F.shiftright("at", 33))
                   .withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), tag)


def _keys(groups, order) -> list:
    return [F.col(g).asc_nulls_first() for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]


def _with_earlier(rows: DataFrame, groups: list, per: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``per``, a table by (groups, range); nulls are values."""
    per = per.withColumnsRenamed({c: f"{c}_of" for c in [*groups, "range"]})
    same = rows["range"] == per["range_of"]
    for g in groups:
        same = same & rows[g].eqNullSafe(per[f"{g}_of"])
    return rows.join(per, same)


def ordinals(df: DataFrame, groups: list, order: list, tag: str = "ordinals") -> DataFrame:
    """``df`` with ``pos``, a row's place (from 0) among the rows of its ``groups`` values in
    ``order``, and ``total``, their number; no task holds a whole group."""
    rows = ranged(df, _keys(groups, order), tag)
    whole = Window.partitionBy(*groups)
    per = rows.groupBy(*groups, "range").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = written(per.select(*groups, "range", (before - F.col("lo")).alias("shift"), F.sum("n").over(whole).alias("total")), f"{tag}-ranges")
    return _with_earlier(rows, groups, per).select(*df.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def sums_before(df: DataFrame, groups: list, order: list, value: str, out: str = "before", tag: str = "sums") -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of its ``groups`` values that come
    earlier in ``order`` (of equal ones, any order); no task holds a whole group."""
    rows = ranged(df, _keys(groups, order), tag)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*groups, "range").agg(F.sum(value).alias("s"))
    per = written(per.select(*groups, "range", F.coalesce(F.sum("s").over(earlier(Window.partitionBy(*groups).orderBy("range"))), F.lit(0)).alias("base")), f"{tag}-ranges")
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*groups, "range").orderBy("at"))), F.lit(0))
    return _with_earlier(rows.withColumn("own", own), groups, per).select(*df.columns, (F.col("own") + F.col("base")).alias(out))
