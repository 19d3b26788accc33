"""Streaming monitors equal their batch form on closed windows; late rows are dropped."""

import datetime as dt
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators.quality import REQUEST_FIELDS
from riskloom.sources.versioned import latest, publish
from riskloom.streaming import commits as CM
from riskloom.streaming import drift as DR
from riskloom.streaming import jobs as J
from riskloom.streaming import monitor as MON


def _events(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    df.coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_drops_late(spark):
    base = tempfile.mkdtemp(prefix="riskloom-stream-")
    src, out = os.path.join(base, "events"), os.path.join(base, "out")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(i, t0 + dt.timedelta(seconds=7 * i), i % 5, "error" if i % 9 == 0 else "view",
             float(i % 100), None) for i in range(600)]          # 70 minutes of events
    _events(spark, rows, src)
    q = J.run_tier_rate(spark, src, out, name="t1")
    q.awaitTermination()
    # second file: one on-time event far ahead (advances the watermark), then a late one
    late_rows = [(10_000, t0 + dt.timedelta(minutes=200), 1, "view", 50.0, None)]
    _events(spark, late_rows, src)
    J.run_tier_rate(spark, src, out, name="t1").awaitTermination()
    _events(spark, [(10_001, t0 + dt.timedelta(minutes=1), 1, "view", 10.0, None)], src)
    J.run_tier_rate(spark, src, out, name="t1").awaitTermination()
    _events(spark, [(10_002, t0 + dt.timedelta(minutes=400), 1, "view", 10.0, None)], src)
    J.run_tier_rate(spark, src, out, name="t1").awaitTermination()
    streamed = spark.read.parquet(out)
    # batch over the on-time events only: the late row (minute 1 after watermark 190) is dropped
    batch_log = J.prediction_log_stream  # noqa: F841  (same projection as the stream)
    ontime = spark.createDataFrame(rows + late_rows, "event_id long, ts timestamp_ntz, user_id long, "
                                                     "event_type string, value double, props string")
    log = ontime.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_type").alias("endpoint"),
                        (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("risk_score"))
    batch = MON.tier_rate(log)
    cols = ["window_start", "tier", "n"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b
    minute0 = [r for r in a if r[0] == dt.datetime(2024, 1, 1, 0, 1)]
    assert sum(r[2] for r in minute0) == sum(1 for x in rows if x[1].minute == 1 and x[1].hour == 0)


def test_tier_totals_upserts(spark):
    base = tempfile.mkdtemp(prefix="riskloom-stream-")
    src = os.path.join(base, "events")
    t0 = dt.datetime(2024, 1, 2)
    rows = [(i, t0 + dt.timedelta(seconds=i), i % 3, "view", float(i % 100), None) for i in range(300)]
    _events(spark, rows, src)
    out = os.path.join(base, "totals")
    J.run_tier_totals(spark, src, out, name="tt_test").awaitTermination()
    got = {r["tier"]: r["total"] for r in J.latest(spark, out, ["tier"]).collect()}
    exp = {}
    for r in rows:
        s = min(r[4], 100.0) / 100.0
        t = "Low" if s < 0.25 else "Medium" if s < 0.5 else "High" if s < 0.75 else "Critical"
        exp[t] = exp.get(t, 0) + 1
    assert got == exp
    # only changed tiers are written, and a batch that runs again adds nothing
    _events(spark, [(900 + i, t0 + dt.timedelta(hours=1), 0, "view", 10.0, None) for i in range(5)], src)
    J.run_tier_totals(spark, src, out, name="tt_test").awaitTermination()
    changed = CM.read(spark, out, "changes").where("batch > 0").select("tier", "total").collect()
    assert [tuple(r) for r in changed] == [("Low", exp["Low"] + 5)]
    before = sorted(map(tuple, J.latest(spark, out, ["tier"]).collect()))
    last = CM.committed(spark, out).agg(F.max("batch")).first()[0]
    assert not CM.write_changes(spark.createDataFrame([("Low", 1)], "tier string, total long"), out, ["tier"], last)
    assert sorted(map(tuple, J.latest(spark, out, ["tier"]).collect())) == before


def test_changes_half_written_compacted_and_replayed(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="riskloom-upserts-"), "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    state = lambda: dict(map(tuple, CM.current(spark, out, ["k"]).collect()))
    want = {}
    for b in range(7):
        CM.write_changes(rows((f"k{b % 3}", b), ("all", b)), out, ["k"], b, compact=3)
        want.update({f"k{b % 3}": b, "all": b})
        assert state() == want
    CM.write_batch(rows(("all", 99)), out, "changes", 7)         # a batch that died before its commit
    assert state() == want
    assert CM.write_changes(rows(("all", 8)), out, ["k"], 7, compact=3) and state() == {**want, "all": 8}
    assert latest(spark, os.path.join(out, "compacted")).number == 2


def test_versions_appear_when_complete(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="riskloom-versions-"), "m")
    assert latest(spark, path) is None

    def broken(folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        publish(spark, path, broken)
    assert latest(spark, path) is None
    publish(spark, path, lambda f: spark.range(5).write.parquet(f) or {"rows": 5})
    with pytest.raises(RuntimeError):
        publish(spark, path, broken)
    seen = latest(spark, path)
    assert (seen.number, seen.meta) == (1, {"rows": 5}) and spark.read.parquet(seen.folder).count() == 5
    assert publish(spark, path, lambda f: spark.range(6).write.parquet(f)).number == 2


def test_scoring_stream_drops_repeats_and_replays(spark):
    base = tempfile.mkdtemp(prefix="riskloom-score-")
    src, out = os.path.join(base, "req"), os.path.join(base, "out")
    t0 = dt.datetime(2024, 1, 1)
    names = [f[0] for f in REQUEST_FIELDS]
    schema = "k long, sent timestamp, " + ", ".join(f"{n} string" for n in names)
    ok = [None if f[1] == "string" and not f[2] else "a" if f[1] == "string" else "1" for f in REQUEST_FIELDS]

    def send(*rows):
        spark.createDataFrame([(k, t0 + dt.timedelta(minutes=m), *[v if n != bad else "x" for n, v in zip(names, ok)]) for k, m, bad in rows], schema) \
            .coalesce(1).write.mode("append").parquet(src)

    def go():
        J.run_scoring(spark, src, spark.read.schema(schema).parquet(src).schema, lambda v: v.select("k"), out, "k", name="s_test").awaitTermination()
        return (sorted(r["k"] for r in CM.read(spark, out, "answers").collect()), sorted(r["k"] for r in CM.read(spark, out, "rejects").collect()))

    numeric = next(f[0] for f in REQUEST_FIELDS if f[1] == "int")
    send((1, 0, None), (2, 1, None), (3, 2, numeric), (1, 0, None))
    assert go() == ([1, 2], [3])
    send((2, 1, None), (4, 3, None))                # 2 comes again in a later batch
    assert go() == ([1, 2, 4], [3])
    assert go() == ([1, 2, 4], [3])
    # the same batch handled again before and after its commit
    again = spark.createDataFrame([(7,)], "k long")
    write = lambda: CM.write_batch(again, out, "answers", 500)
    write()
    assert 7 not in go()[0]
    assert CM.once(spark, out, 500, write) and not CM.once(spark, out, 500, write)
    assert go()[0].count(7) == 1


def test_drift_baseline_merges_and_is_read_back(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="riskloom-drift-"), "b")
    d = spark.range(3000).select((F.col("id") % 3).alias("part"), ((F.col("id") * 7919) % 1009).cast("double").alias("x"),
                                 F.lit(5.0).alias("flat"), F.lit(None).cast("double").alias("none"), F.timestamp_seconds(F.col("id") * 100).alias("ts"))
    with pytest.raises(ValueError):
        DR.load_baseline(spark, folder)
    cols = ["x", "flat", "none"]
    DR.save_baseline(DR.sketch_parts(d.where("part = 0"), cols, "part"), folder)
    DR.extend_baseline(DR.sketch_parts(d.where("part > 0"), cols, "part"), folder)
    DR.extend_baseline(DR.sketch_parts(d.where("part = 2"), cols, "part"), folder)          # a part again: replaced
    got = {r["feature"]: r for r in DR.load_baseline(spark, folder).collect()}
    once = {r["feature"]: r for r in DR.quantile_bins(DR.sketch_parts(d, cols, F.lit(0))).collect()}
    assert got == once and set(got) == {"x", "flat"} and got["x"]["n"] == 3000
    xs = [r["x"] for r in d.select("x").collect()]
    e = [-math.inf, *got["x"]["edges"], math.inf]
    assert got["x"]["expected"] == [sum(a < x <= b for x in xs) for a, b in zip(e, e[1:])]
    assert got["flat"]["edges"] == [5.0] and got["flat"]["expected"] == [3000, 0]
    same = DR.drift(d, DR.load_baseline(spark, folder), ["x", "flat"], "10 days").collect()
    assert {r["feature"]: r["psi"] for r in same} == {"x": 0.0, "flat": 0.0} and {r["status"] for r in same} == {"ok"}
    moved = DR.drift(d.withColumn("x", F.col("x") + 400), DR.load_baseline(spark, folder), ["x"], "10 days").first()
    assert moved["status"] == "critical"
