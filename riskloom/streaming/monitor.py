"""Monitoring aggregates over a prediction log ``(request_id, ts, endpoint,
is_error, risk_score, latency_s, batch_id)``.

Each aggregate is a pure ``DataFrame → DataFrame`` function, so the same code
runs in batch (checked against SQL) and on a streaming DataFrame (with a
watermark, see ``riskloom.streaming.jobs``).  State is kept mergeable: bucket
counts per window, never raw values, so quantiles come from bucket counts
(linear interpolation inside the bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions import exprs as X


def tiered(log: DataFrame, thresholds=C.FIXED_TIERS, score: str = "risk_score") -> DataFrame:
    lo, med, hi = thresholds
    return log.withColumn("tier", X.risk_tier(score, F.lit(lo), F.lit(med), F.lit(hi)))


def tier_rate(log: DataFrame, window: str = "1 minute", seconds: int = 60,
              thresholds=C.FIXED_TIERS) -> DataFrame:
    """Predictions per second by tier over tumbling windows."""
    t = tiered(log, thresholds)
    g = t.groupBy(F.window("ts", window).alias("w"), "tier").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tier",
                    "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def tier_totals(log: DataFrame, thresholds=C.FIXED_TIERS) -> DataFrame:
    return tiered(log, thresholds).groupBy("tier").agg(F.count(F.lit(1)).alias("total"))


def bucket_counts(value: Column, bounds) -> list[Column]:
    """Cumulative ``le`` counts for each bound plus +Inf (count of non-NULL)."""
    return [F.count_if(value <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(bounds)] + \
        [F.count(value).alias(f"le_{len(bounds)}")]


def histogram_quantile(q: float, bounds, prefix: str = "le_") -> Column:
    """Quantile from cumulative bucket counts: find the first bucket whose count
    reaches q·total and interpolate linearly inside it (lower edge 0 for the
    first bucket); a rank in the +Inf bucket returns the highest finite bound."""
    n = len(bounds)
    total = F.col(f"{prefix}{n}")
    rank = F.lit(q) * total
    expr = None
    for i, b in enumerate(bounds):
        prev = F.col(f"{prefix}{i - 1}") if i > 0 else F.lit(0)
        lower = F.lit(bounds[i - 1]) if i > 0 else F.lit(0.0)
        cnt = F.col(f"{prefix}{i}") - prev
        val = lower + (F.lit(b) - lower) * (rank - prev) / cnt
        cond = F.col(f"{prefix}{i}") >= rank
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    expr = expr.otherwise(F.lit(float(bounds[-1])))
    return F.when(total > 0, expr)


def sliding(log: DataFrame, keys, counts: list[Column], minutes: int = 5) -> DataFrame:
    """Counts per window of ``minutes`` minutes, sliding by one minute, and ``keys``;
    windows are ``w.start, w.end``.

    In batch, rows are counted per minute first and only these counts are copied to
    the windows that hold the minute.  On a stream the window function assigns rows
    directly (one stateful step)."""
    if log.isStreaming:
        return log.groupBy(F.window("ts", f"{minutes} minutes", "1 minute").alias("w"), *keys).agg(*counts)
    per = log.groupBy(F.date_trunc("minute", "ts").alias("_m"), *keys).agg(*counts)
    own = per.columns[1 + len(keys):]
    starts = F.sequence(F.col("_m") - F.expr(f"interval {minutes - 1} minutes"), F.col("_m"), F.expr("interval 1 minute"))
    w = F.struct(F.col("_s").alias("start"), (F.col("_s") + F.expr(f"interval {minutes} minutes")).alias("end"))
    return (per.withColumn("_s", F.explode(starts)).withColumn("w", w)
            .groupBy("w", *keys).agg(*[F.sum(c).alias(c) for c in own]))


def latency_quantiles(log: DataFrame, bounds=C.LATENCY_BUCKETS) -> DataFrame:
    """P95/P99 latency in ms per endpoint over sliding windows, from bucket counts."""
    g = sliding(log, ["endpoint"], bucket_counts(F.col("latency_s"), bounds))
    return g.select(F.col("w.start").alias("window_start"), "endpoint",
                    F.round(histogram_quantile(0.95, bounds) * 1000, 6).alias("p95_ms"),
                    F.round(histogram_quantile(0.99, bounds) * 1000, 6).alias("p99_ms"))


def score_buckets(log: DataFrame, bounds=C.SCORE_BUCKETS, seconds: int = 300) -> DataFrame:
    """Per-second rate of cumulative score buckets (``le``) over sliding windows."""
    g = sliding(log, [], bucket_counts(F.col("risk_score"), bounds))
    les = list(bounds) + [float("inf")]
    s = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"),
                                     F.round(F.col(f"le_{i}") / seconds, 6).alias("per_second"))
                            for i, b in enumerate(les)]))
    return g.select(F.col("w.start").alias("window_start"), s.alias("x")) \
        .select("window_start", "x.le", "x.per_second")


def error_rate(log: DataFrame, seconds: int = 300) -> DataFrame:
    """Errors per second by type over sliding windows (type = endpoint of the error)."""
    # counted, not filtered, below: on a stream all events move the watermark
    e = log.withColumn("error_type", F.col("endpoint"))
    g = sliding(e, ["error_type"], [F.count_if("is_error").alias("n")]).where("n > 0")
    return g.select(F.col("w.start").alias("window_start"), "error_type", "n",
                    F.round(F.col("n") / seconds, 6).alias("per_second"))


def batch_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))


def batch_size_hist(log: DataFrame, bounds=C.BATCH_SIZE_BUCKETS) -> DataFrame:
    """Cumulative histogram of batch sizes (rows per batch id)."""
    return size_hist(batch_sizes(log), bounds)


def size_hist(sizes: DataFrame, bounds=C.BATCH_SIZE_BUCKETS) -> DataFrame:
    a = sizes.agg(*bucket_counts(F.col("size"), bounds))
    les = list(bounds) + [float("inf")]
    s = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("count"))
                            for i, b in enumerate(les)]))
    return a.select(s.alias("x")).select("x.*")


def psi(baseline: DataFrame, current: DataFrame, features, bins: int = 10, eps: float = 1e-4,
        warn: float = C.PSI_WARNING, critical: float = C.PSI_CRITICAL) -> DataFrame:
    """Population stability index per feature against the baseline's quantile bins.

    Edges: exact baseline deciles (linear interpolation), deduplicated; bin =
    number of edges strictly below the value (right-closed bins, open ends).
    PSI = Σ (a − e) · ln(a / e) with proportions floored at eps.
    """
    from riskloom.functions.cumulative import grouped_exact_quantiles
    from riskloom.functions.exprs import linspace
    probs = linspace(0.0, 1.0, bins + 1)[1:-1]

    def unpivoted(df, side):
        s = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
        return df.select(s.alias("x")).select("x.*", F.lit(side).alias("side")).where(F.col("value").isNotNull())

    # whatever the number of features: the baseline is read for its edges, then each side once
    base = unpivoted(baseline, "expected")
    q = grouped_exact_quantiles(base, "value", ["feature"], probs)
    b = F.lit(0)
    for c in features:
        edges = sorted(set(q.get((c,), [])))
        at = sum((F.col("value") > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
        b = F.when(F.col("feature") == c, at).otherwise(b)
    long = base.unionByName(unpivoted(current, "actual")).select("feature", "side", b.alias("bin"))
    cnt = long.groupBy("feature", "side", "bin").agg(F.count(F.lit(1)).alias("n"))
    pv = cnt.groupBy("feature", "bin").pivot("side", ["expected", "actual"]).agg(F.first("n")) \
        .na.fill(0, ["expected", "actual"])
    tot = pv.groupBy("feature").agg(F.sum("expected").alias("te"), F.sum("actual").alias("ta"))
    j = pv.join(tot, "feature")
    e = F.greatest(F.col("expected") / F.col("te"), F.lit(eps))
    a = F.greatest(F.col("actual") / F.col("ta"), F.lit(eps))
    out = j.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return out.select("feature", F.round("psi", 6).alias("psi"),
                      F.when(F.col("psi") >= critical, "critical").when(F.col("psi") >= warn, "warning")
                      .otherwise("ok").alias("status"))
