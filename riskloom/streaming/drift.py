"""Feature drift against a stored training baseline, per day of a stream.

The baseline is mergeable: each part of the training data (a load, a month) is reduced to
one quantile sketch and a count per feature; any set of parts merges into one baseline of
``bins`` quantile bins per feature with their expected counts, kept as a version of a
folder.  Sketches hold up to ``SKETCH_K`` values exactly; beyond, ranks have the sketch's
error (about 2 / SKETCH_K).  The stream is joined with the baseline (features x bins, a
size the schema sets); its state is one count per day, feature and bin, never values.
A day comes out once the watermark has passed its end, with its stability index
Σ (a − e) · ln(a / e) over the bins, shares floored at ``EPS``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.sources.versioned import Version, latest, publish

SKETCH_K = 8192
BINS = 10
EPS = 1e-4


def sketch_parts(df: DataFrame, features, part: Column | str) -> DataFrame:
    """``part, feature, n, sketch`` of the training rows (NULLs left out)."""
    aggs = []
    for i, c in enumerate(features):
        v = F.col(f"`{c}`").cast("double")
        aggs += [F.count(v).alias(f"n_{i}"), F.kll_sketch_agg_double(v, SKETCH_K).alias(f"s_{i}")]
    wide = df.groupBy((F.col(part) if isinstance(part, str) else part).alias("part")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{i}").alias("n"), F.col(f"s_{i}").alias("sketch")) for i, c in enumerate(features)])
    return wide.select("part", F.explode(rows).alias("r")).select("part", "r.*")


def quantile_bins(parts: DataFrame, bins: int = BINS) -> DataFrame:
    """``feature, edges, expected, n`` of the merged parts: distinct inner quantiles, and the
    training rows in each of the bins between them (right-closed, open ends)."""
    merged = parts.where("n > 0").groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    inner = [F.kll_sketch_get_quantile_double("sketch", F.lit(i / bins)) for i in range(1, bins)]
    spark = parts.sparkSession
    # a row per feature: edges go back in as literals, which is what rank lookups take
    rows = [(r["feature"], sorted(set(r["e"]))) for r in merged.select("feature", F.array(*inner).alias("e")).collect()]
    edges = spark.createDataFrame(rows, "feature string, edges array<double>")
    below = F.lit(None).cast("array<double>")
    for name, e in rows:
        below = F.when(F.col("feature") == name, F.array(*[F.kll_sketch_get_rank_double("sketch", F.lit(x)) for x in e])).otherwise(below)
    up_to = F.concat(F.transform(F.col("below"), lambda r: F.round(r * F.col("n"))), F.array(F.col("n").cast("double")))
    counts = F.zip_with(up_to, F.concat(F.array(F.lit(0.0)), F.slice(up_to, 1, F.size("below"))), lambda a, b: (a - b).cast("long"))
    return merged.withColumn("below", below).select("feature", "n", counts.alias("expected")).join(edges, "feature") \
        .select("feature", "edges", "expected", "n")


def save_baseline(parts: DataFrame, path: str, bins: int = BINS) -> Version:
    """Parts and their bins as the newest version of the baseline folder."""
    def write(folder: str) -> dict:
        parts.write.parquet(os.path.join(folder, "parts"))
        quantile_bins(parts.sparkSession.read.parquet(os.path.join(folder, "parts")), bins).coalesce(1).write.parquet(os.path.join(folder, "bins"))
        return {"bins": bins}
    return publish(parts.sparkSession, path, write)


def extend_baseline(parts: DataFrame, path: str) -> Version:
    """A new version with these parts added (parts of the same name replaced): earlier
    training data is not read again."""
    old = latest(parts.sparkSession, path)
    if old is None:
        return save_baseline(parts, path)
    kept = parts.sparkSession.read.parquet(os.path.join(old.folder, "parts")).join(parts.select("part").distinct(), "part", "left_anti")
    return save_baseline(kept.unionByName(parts), path, old.meta["bins"])


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    found = latest(spark, path)
    if found is None:
        raise ValueError(f"no complete baseline in {path}")
    return spark.read.schema("feature string, edges array<double>, expected array<bigint>, n long").parquet(os.path.join(found.folder, "bins"))


def drift(rows: DataFrame, baseline: DataFrame, features, width: str = "1 day", bins: int = BINS,
          warn: float = C.PSI_WARNING, critical: float = C.PSI_CRITICAL) -> DataFrame:
    """``window_start, feature, n, psi, status`` of ``rows(ts, features…)``, batch or stream."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features]))
    long = rows.select("ts", pairs.alias("x")).select("ts", "x.*").where(F.col("value").isNotNull())
    at = F.size(F.filter("edges", lambda e: F.col("value") > e))
    met = long.join(baseline, "feature").withColumn("bin", at)
    counted = met.groupBy(F.window("ts", width).alias("w"), "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.first("expected").alias("expected"), F.first("n").alias("of"),
        F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)]).alias("actual"))
    share = lambda c, total: F.greatest(c / total, F.lit(EPS))
    terms = F.zip_with(F.col("expected"), F.slice("actual", 1, F.size("expected")), lambda e, a: F.struct(
        share(e, F.col("of")).alias("e"), share(a, F.col("rows")).alias("a")))
    psi = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + (t["a"] - t["e"]) * F.log(t["a"] / t["e"]))
    out = counted.withColumn("psi", psi)
    return out.select(F.col("w.start").alias("window_start"), "feature", F.col("rows").alias("n"), F.round("psi", 6).alias("psi"),
                      F.when(F.col("psi") >= critical, "critical").when(F.col("psi") >= warn, "warning").otherwise("ok").alias("status"))
