"""Structured Streaming jobs: the monitoring aggregates over a file stream of
prediction-log events, and request scoring with a reject stream.

Event time needs TIMESTAMP (parquet NTZ is cast); a 10-minute watermark bounds
state and drops events later than that; windowed counts are emitted in
append mode once their window closes.  Checkpoints live under the shared
checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir, written
from riskloom.streaming import commits as CM
from riskloom.streaming import drift as DR
from riskloom.streaming import monitor as MON

WATERMARK = "10 minutes"
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def prediction_log_stream(spark: SparkSession, path: str, schema: str = EVENTS_SCHEMA,
                          max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    e = r.parquet(path)
    return e.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"), (F.col("event_type") == "error").alias("is_error"),
        (F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)).alias("risk_score"),
        (F.col("value") / F.lit(200.0)).alias("latency_s"), F.col("user_id").alias("batch_id"))


def _ckpt(spark: SparkSession, name: str, src: str = "") -> str:
    """Per-query checkpoint folder; keyed by the source path too, so a query name
    reused for a different source never resumes someone else's offsets."""
    tag = hashlib.md5(src.encode()).hexdigest()[:10]
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}_{tag}")


def run_tier_rate(spark: SparkSession, src: str, out: str, name: str = "tier_rate",
                  watermark: str = WATERMARK, available_now: bool = True):
    """Windowed tier counts, append mode, parquet sink; returns the finished query."""
    log = prediction_log_stream(spark, src).withWatermark("ts", watermark)
    agg = MON.tier_rate(log)
    w = agg.writeStream.outputMode("append").format("parquet") \
        .option("path", out).option("checkpointLocation", _ckpt(spark, name, src))
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    return q


WINDOWED = {"latency": MON.latency_quantiles, "score_buckets": MON.score_buckets, "error_rate": MON.error_rate}


def run_windowed(spark: SparkSession, monitor: str, src: str, out: str, watermark: str = WATERMARK):
    """A sliding-window monitor (a key of ``WINDOWED``), append mode, parquet sink: a
    window is written once the watermark has passed its end."""
    log = prediction_log_stream(spark, src).withWatermark("ts", watermark)
    return WINDOWED[monitor](log).writeStream.outputMode("append").format("parquet").option("path", out) \
        .option("checkpointLocation", _ckpt(spark, monitor, src)).trigger(availableNow=True).start()


def run_drift(spark: SparkSession, src: str, baseline: str, features, out: str, watermark: str = WATERMARK):
    """Daily drift of a prediction log's ``features`` against the newest version of the stored
    ``baseline``, append mode, parquet sink: a day is written once the watermark has passed it."""
    log = prediction_log_stream(spark, src).withWatermark("ts", watermark)
    found = DR.drift(log, DR.load_baseline(spark, baseline), features)
    return found.writeStream.outputMode("append").format("parquet").option("path", out) \
        .option("checkpointLocation", _ckpt(spark, "drift", src)).trigger(availableNow=True).start()


def run_totals(spark: SparkSession, agg: DataFrame, keys: list[str], out: str, name: str, src: str):
    """Running totals in update mode: a batch writes the keys that changed, and ``latest``
    reads every key's newest row."""
    def handle(batch: DataFrame, batch_id: int):
        CM.write_changes(batch, out, keys, batch_id)

    return agg.writeStream.outputMode("update").foreachBatch(handle) \
        .option("checkpointLocation", _ckpt(spark, name, src)).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The present state of a running total."""
    return CM.current(spark, out, keys)


def run_tier_totals(spark: SparkSession, src: str, out: str, name: str = "tier_totals", max_files: int | None = None):
    """Running totals per tier."""
    return run_totals(spark, MON.tier_totals(prediction_log_stream(spark, src, max_files=max_files)), ["tier"], out, name, src)


def run_batch_sizes(spark: SparkSession, src: str, out: str, name: str = "batch_sizes"):
    """Running row counts per batch id; the histogram is taken of the newest counts
    (``MON.size_hist``)."""
    return run_totals(spark, MON.batch_sizes(prediction_log_stream(spark, src)), ["batch_id"], out, name, src)


def run_scoring(spark: SparkSession, src: str, schema, answer, out: str, key: str, ts: str = "sent",
                name: str = "scoring", delay: str = WATERMARK, max_files: int | None = None):
    """Answer arriving requests: the first row of every request id within ``delay`` counts
    (state is bounded by the watermark), rows are checked, ``answer(valid rows)`` goes to
    ``answers`` and rejected rows with their violations to ``rejects``, both under the
    batch's commit (``commits.read``)."""
    from riskloom.operators.quality import row_constraints

    def handle(batch: DataFrame, batch_id: int):
        def write():
            checked = written(row_constraints(batch), f"{name}-checked")
            CM.write_batch(answer(checked.where(F.size("violations") == 0).drop("violations")), out, "answers", batch_id)
            CM.write_batch(checked.where(F.size("violations") > 0), out, "rejects", batch_id)
        CM.once(spark, out, batch_id, write)

    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    stream = r.parquet(src).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return stream.writeStream.foreachBatch(handle) \
        .option("checkpointLocation", _ckpt(spark, name, src)).trigger(availableNow=True).start()
