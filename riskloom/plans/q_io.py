"""Registered queries: sources and sinks (2.1) as write/read round trips."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import ENC_COLS, nulled_sql, with_encounter, with_scored
from riskloom.session import scratch_path
from riskloom.sources import io as IO
from riskloom.sources.encounters import encounters, scored
from riskloom.sources.tables import infer_csv, read_table, scan_csv

KEY = "encounter_id"


def _path(spark, sf_dir, name):
    tag = hashlib.md5((spark.sparkContext.applicationId + sf_dir).encode()).hexdigest()[:10]
    return scratch_path(spark, f"{name}_{tag}")


@query("scan_parquet")
def q_scan_parquet(spark, sf_dir):
    """Column-pruned parquet scan with a pushed-down filter."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    return o.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_orderdate")


oracle("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'")


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """Encounter → header CSV → scan with an explicit schema, '?' read as NULL."""
    enc = encounters(spark, sf_dir)
    path = _path(spark, sf_dir, "encounter_csv")
    IO.sink_csv(enc, path, null_value="?")
    return scan_csv(spark, path, schema=enc.schema, null_value="?")


oracle("scan_csv", with_encounter("SELECT " + ", ".join(nulled_sql(c) for c in ENC_COLS) + " FROM encounter"))


_MIXED = {      # column: (Spark and SQL expression over orders, type that its text has)
    "o_orderkey": ("o_orderkey", "bigint"), "price": ("CAST(o_custkey AS DOUBLE) / 8", "double"), "placed": ("CAST(o_orderdate AS DATE)", "date"),
    "priority": ("o_orderpriority", "string"), "odd": ("o_custkey % 2 = 1", "boolean"),
    "some": ("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END", "bigint"), "code": ("CASE WHEN o_orderkey % 1000 = 1 THEN 'x' ELSE '7' END", "string")}


@query("scan_csv_inferred")
def q_scan_csv_inferred(spark, sf_dir):
    """A CSV without schema, every 50th order's line cut short: each column's type as found
    and its values, and the malformed rows, which are kept."""
    path = scratch_path(spark, f"mixed_csv_{uuid.uuid4().hex}")
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    cut = F.col("o_orderkey") % 50 == 0
    orders.where(~cut).selectExpr(*[f"{e} AS {c}" for c, (e, _) in _MIXED.items()]).write.option("header", True).csv(path)
    header = spark.createDataFrame([(",".join(_MIXED),)], "value string")
    header.unionByName(orders.where(cut).select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))).coalesce(1).write.mode("append").text(path)
    rows = infer_csv(spark, path)
    types = F.create_map(*[F.lit(x) for f in rows.schema for x in (f.name, f.dataType.simpleString())])
    counts = rows.agg(*[F.count(f"`{c}`").alias(c) for c in rows.columns])
    return counts.unpivot([], rows.columns, "column", "n").select("column", types[F.col("column")].alias("type"), "n")


oracle("scan_csv_inferred", " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS type, count({e}) AS n FROM orders WHERE o_orderkey % 50 <> 0" for c, (e, t) in _MIXED.items())
    + " UNION ALL SELECT '_malformed', 'string', count(*) FROM orders WHERE o_orderkey % 50 = 0")


@query("sink_csv")
def q_sink_csv(spark, sf_dir):
    enc = encounters(spark, sf_dir)
    path = _path(spark, sf_dir, "sink_csv")
    IO.sink_csv(enc, path)
    back = spark.read.option("header", True).csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"))


oracle("sink_csv", with_encounter("SELECT count(*) AS rows FROM encounter"))


@query("sink_parquet")
def q_sink_parquet(spark, sf_dir):
    """Split-partitioned write; reading one split prunes the other directories."""
    from riskloom.plans.q_model import prepared
    d, _ = prepared(spark, sf_dir)
    path = _path(spark, sf_dir, "sink_parquet")
    IO.sink_parquet(d, path, partition_by=("split",))
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def _split_counts_sql():
    from riskloom.plans.q_features import split_sql
    from riskloom.plans.sqlparts import with_cleaned
    return with_cleaned("SELECT split, count(*) AS rows FROM splitted GROUP BY split",
                        split_sql("cleaned").strip())


oracle("sink_parquet", _split_counts_sql())


@query("sink_json_metrics")
def q_sink_json_metrics(spark, sf_dir):
    from riskloom.operators.metrics import headline_metrics
    m = headline_metrics(scored(spark, sf_dir, with_groups=False).cache())
    path = _path(spark, sf_dir, "metrics_json")
    IO.sink_json_metrics(m, path)
    return IO.read_json_metrics(spark, path)


def _metrics_sql():
    from riskloom.plans.q_metrics import _REPORT_CTES, _REPORT_SQL
    return with_scored(f"SELECT metric, round(value, 6) AS value FROM ({_REPORT_SQL}) r", _REPORT_CTES)


oracle("sink_json_metrics", _metrics_sql())


@query("params_io")
def q_params_io(spark, sf_dir):
    """Persist fitted parameters (tier thresholds, medians, the consensus's selected
    features, the score at the flag percentile) and reload."""
    from riskloom.functions.cumulative import exact_quantiles
    from riskloom.operators import strata as S
    from riskloom.plans.q_model import _sql_consensus, prepared_medians
    sc = scored(spark, sf_dir, with_groups=False).cache()
    thr = S.tier_thresholds(sc)
    flag = exact_quantiles(sc, "score", [C.FLAG_PERCENTILE / 100])[0]
    names = [r["feature"] for r in _sql_consensus(spark, sf_dir).where("in_2plus").orderBy("mean_rank", "feature").collect()]
    path = _path(spark, sf_dir, "params")
    IO.save_params(spark, path, {"tier_thresholds": thr, "medians": prepared_medians(spark, sf_dir), "selected_features": names,
                                 "flag_percentile": C.FLAG_PERCENTILE, "flag_threshold": flag})
    sc.unpersist()
    return IO.load_params(spark, path)
