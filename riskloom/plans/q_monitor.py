"""Registered queries: scoring and monitoring (2.12)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import tier_sql, with_plog
from riskloom.session import scratch_path, written
from riskloom.sources.encounters import prediction_log
from riskloom.streaming import monitor as MON

KEY = "encounter_id"
LABEL = C.LABEL_COL
_LO, _MED, _HI = C.FIXED_TIERS


def _log(spark, sf_dir):
    return prediction_log(spark, sf_dir)


@query("tier_rate_1m")
def q_tier_rate(spark, sf_dir):
    return MON.tier_rate(_log(spark, sf_dir))


_TIER = tier_sql("risk_score", str(_LO), str(_MED), str(_HI))
oracle("tier_rate_1m", with_plog(
    f"SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, "
    f"time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, {_TIER} AS tier, "
    "count(*) AS n, round(count(*) / 60.0, 6) AS per_second FROM plog GROUP BY 1, 2, 3"))


@query("tier_totals")
def q_tier_totals(spark, sf_dir):
    return MON.tier_totals(_log(spark, sf_dir))


oracle("tier_totals", with_plog(f"SELECT {_TIER} AS tier, count(*) AS total FROM plog GROUP BY 1"))

_SLIDE = ("slid AS (SELECT p.*, time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start "
          "FROM plog p CROSS JOIN range(0, 5) r(k))")


def _hq_sql(q, bounds):
    n = len(bounds)
    parts = []
    for i, b in enumerate(bounds):
        prev = f"le_{i - 1}" if i > 0 else "0"
        lower = repr(float(bounds[i - 1])) if i > 0 else "0.0"
        parts.append(f"WHEN le_{i} >= {q} * le_{n} THEN {lower} + ({b!r} - {lower}) * "
                     f"({q} * le_{n} - {prev}) / (le_{i} - {prev})")
    return f"CASE WHEN le_{n} > 0 THEN CASE {' '.join(parts)} ELSE {float(bounds[-1])!r} END END"


def _buckets_sql(col, bounds):
    return ", ".join([f"count_if({col} <= {b!r}) AS le_{i}" for i, b in enumerate(bounds)]
                     + [f"count({col}) AS le_{len(bounds)}"])


@query("latency_p95_p99")
def q_latency(spark, sf_dir):
    return MON.latency_quantiles(_log(spark, sf_dir))


oracle("latency_p95_p99", with_plog(
    f"SELECT window_start, endpoint, round(({_hq_sql(0.95, C.LATENCY_BUCKETS)}) * 1000, 6) AS p95_ms, "
    f"round(({_hq_sql(0.99, C.LATENCY_BUCKETS)}) * 1000, 6) AS p99_ms FROM (SELECT window_start, endpoint, "
    f"{_buckets_sql('latency_s', C.LATENCY_BUCKETS)} FROM slid GROUP BY 1, 2) b", _SLIDE))


@query("score_buckets")
def q_score_buckets(spark, sf_dir):
    return MON.score_buckets(_log(spark, sf_dir))


_LES = list(C.SCORE_BUCKETS) + [float("inf")]
oracle("score_buckets", with_plog(
    "SELECT window_start, le, per_second FROM (SELECT window_start, "
    f"{_buckets_sql('risk_score', C.SCORE_BUCKETS)} FROM slid GROUP BY 1) b, LATERAL (VALUES "
    + ", ".join(f"({('cast(' + repr(str(le)) + ' AS DOUBLE)') if le == float('inf') else repr(float(le)) + '::DOUBLE'}, "
                f"round(le_{i} / 300.0, 6))" for i, le in enumerate(_LES))
    + ") v(le, per_second)", _SLIDE))


@query("error_rate")
def q_error_rate(spark, sf_dir):
    return MON.error_rate(_log(spark, sf_dir))


oracle("error_rate", with_plog(
    "SELECT window_start, endpoint AS error_type, count(*) AS n, round(count(*) / 300.0, 6) AS per_second "
    "FROM slid WHERE is_error GROUP BY 1, 2", _SLIDE))


@query("batch_size_hist")
def q_batch_size(spark, sf_dir):
    return MON.batch_size_hist(_log(spark, sf_dir))


_BLES = list(C.BATCH_SIZE_BUCKETS) + [float("inf")]
oracle("batch_size_hist", with_plog(
    "SELECT le, count FROM (SELECT " + _buckets_sql("size", C.BATCH_SIZE_BUCKETS)
    + " FROM (SELECT batch_id, count(*) AS size FROM plog GROUP BY batch_id) s) b, LATERAL (VALUES "
    + ", ".join(f"({('cast(' + repr(str(le)) + ' AS DOUBLE)') if le == float('inf') else repr(float(le)) + '::DOUBLE'}, le_{i})"
                for i, le in enumerate(_BLES)) + ") v(le, count)"))

_SPLIT_TS = "2024-01-16"
_PSI_FEATURES = ["risk_score", "latency_s"]


@query("psi_drift")
def q_psi(spark, sf_dir):
    """Drift of the second half of the log against the first half as baseline."""
    log = _log(spark, sf_dir).cache()
    base = log.where(F.col("ts") < F.lit(_SPLIT_TS).cast("timestamp"))
    cur = log.where(F.col("ts") >= F.lit(_SPLIT_TS).cast("timestamp"))
    return MON.psi(base, cur, _PSI_FEATURES)


def _psi_sql():
    from riskloom.functions.exprs import linspace
    probs = "[" + ", ".join(repr(p) for p in linspace(0.0, 1.0, 11)[1:-1]) + "]"
    parts = []
    for c in _PSI_FEATURES:
        parts.append(
            f"SELECT '{c}' AS feature, CASE WHEN ts < TIMESTAMP '{_SPLIT_TS}' THEN 'e' ELSE 'a' END AS side, "
            f"len(list_filter(e, lambda x: x < {c})) AS bin FROM plog CROSS JOIN "
            f"(SELECT list_distinct(quantile_cont({c}, {probs})) AS e FROM plog WHERE ts < TIMESTAMP '{_SPLIT_TS}') q "
            f"WHERE {c} IS NOT NULL")
    long = " UNION ALL ".join(parts)
    return with_plog(
        "SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 "
        "THEN 'warning' ELSE 'ok' END AS status FROM (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM ("
        "SELECT feature, greatest(ne / sum(ne) OVER (PARTITION BY feature), 1e-4) AS e, "
        "greatest(na / sum(na) OVER (PARTITION BY feature), 1e-4) AS a FROM ("
        "SELECT feature, bin, count_if(side = 'e') AS ne, count_if(side = 'a') AS na FROM (" + long
        + ") l GROUP BY feature, bin) c) p GROUP BY feature) x")


oracle("psi_drift", _psi_sql())


_DRIFT_FEATURES = ["risk_score", "latency_s", "batch_id"]


@query("psi_drift_stream")
def q_psi_stream(spark, sf_dir):
    """Daily drift of the log's second half, as a stream, against the stored baseline of
    its first half, which is built from two parts merged."""
    from riskloom.streaming import drift as DR
    from riskloom.streaming import jobs as J
    src, base = _stream_run(spark, sf_dir)
    log, events = _log(spark, sf_dir), spark.read.parquet(src)
    split = F.lit(_SPLIT_TS).cast("timestamp")
    parts = written(DR.sketch_parts(log.where(F.col("ts") < split), _DRIFT_FEATURES, F.weekofyear("ts")), "drift-parts")
    folder = os.path.join(base, "baseline")
    first = parts.agg(F.min("part").alias("p")).first()["p"]
    DR.save_baseline(parts.where(F.col("part") == first), folder)
    DR.extend_baseline(parts.where(F.col("part") != first), folder)
    events.where(F.col("ts").cast("timestamp") >= split).write.parquet(os.path.join(base, "events"))
    J.run_drift(spark, os.path.join(base, "events"), folder, _DRIFT_FEATURES, os.path.join(base, "out")).awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def _psi_stream_sql():
    from riskloom.streaming.drift import BINS
    split = f"TIMESTAMP '{_SPLIT_TS}'"
    probs = "[" + ", ".join(repr(i / BINS) for i in range(1, BINS)) + "]"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, ts, CAST({c} AS DOUBLE) AS v FROM plog WHERE {c} IS NOT NULL" for c in _DRIFT_FEATURES)
    bin_of = "len(list_filter(edges, lambda x: x < v))"
    return with_plog(
        "SELECT window_start, feature, n, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END AS status "
        "FROM (SELECT window_start, feature, any_value(t) AS n, sum((a - e) * ln(a / e)) AS psi FROM (SELECT d.day AS window_start, d.feature, d.t, "
        "greatest(b.c / b.t, 1e-4) AS e, greatest(coalesce(c.c, 0) / d.t, 1e-4) AS a FROM dt d JOIN bt b ON b.feature = d.feature "
        "LEFT JOIN dc c ON c.day = d.day AND c.feature = d.feature AND c.bin = b.bin) s GROUP BY 1, 2) p "
        "WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM plog)",
        f"long AS ({rows}), ed AS (SELECT feature, list_sort(list_distinct(quantile_disc(v, {probs}))) AS edges FROM long WHERE ts < {split} GROUP BY feature), "
        f"bc AS (SELECT feature, {bin_of} AS bin, count(*) AS c FROM long JOIN ed USING (feature) WHERE ts < {split} GROUP BY 1, 2), "
        "bt AS (SELECT e.feature, r.bin, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY e.feature) AS t FROM (SELECT feature, unnest(range(0, len(edges) + 1)) AS bin FROM ed) r "
        "JOIN ed e USING (feature) LEFT JOIN bc ON bc.feature = r.feature AND bc.bin = r.bin), "
        f"dc AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, feature, {bin_of} AS bin, count(*) AS c FROM long JOIN ed USING (feature) WHERE ts >= {split} GROUP BY 1, 2, 3), "
        "dt AS (SELECT day, feature, CAST(sum(c) AS BIGINT) AS t FROM dc GROUP BY 1, 2)")


oracle("psi_drift_stream", _psi_stream_sql())


# ---- scoring -------------------------------------------------------------------------------
def answers(rm, background):
    """The one answer to model inputs, in batch and on a stream: score, tier, top factors,
    base rate and expected value.  Score, factors and base rate come from one score
    function, so a row's ``expected`` (mean over its background draws) plus its factors
    is its score."""
    from riskloom.operators import explain as X
    from riskloom.operators.strata import assign_tier, fixed_thresholds
    bg = written(background, "background")
    base = X.base_rate(rm.predict_proba, bg)

    def answer(rows):
        attr = written(X.tree_sampling(rows, bg, KEY, rm.features, rm, draws=SHAP_DRAWS), "attribution")
        factors = X.factors_struct(X.local_explanation(attr, KEY), KEY)
        total = attr.groupBy(KEY).agg(F.sum("phi").alias("_phi"))
        out = assign_tier(rm.predict_proba(rows), fixed_thresholds(), "score", "risk_tier").join(total, KEY, "left").join(factors, KEY, "left")
        return out.select(KEY, "score", F.round("score", 4).alias("risk_score"), "risk_tier", F.lit(round(base, 4)).alias("base_rate"),
                          F.round(F.col("score") - F.col("_phi"), 4).alias("expected"), "top_factors")
    return answer


def _answers(spark, sf_dir):
    from riskloom.operators import explain as X
    from riskloom.plans.q_model import _calibrated, _splits
    rm, _, _ = _calibrated(spark, sf_dir)
    return rm, answers(rm, X.hash_rank_sample(_splits(spark, sf_dir)[0], KEY))


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """Score, tier, top factors, base rate and version for a batch of rows: the whole population."""
    from riskloom.plans.q_model import prepared
    batch, _ = prepared(spark, sf_dir)
    if batch.isEmpty():
        raise ValueError("empty batch")
    return _answers(spark, sf_dir)[1](batch).select(
        F.concat(F.lit("batch_"), F.col(KEY).cast("string")).alias("patient_id"), "risk_score", "risk_tier", "base_rate", "expected", "top_factors",
        F.lit("1.0.0").alias("model_version"))


SHAP_DRAWS = 8


# Requests as they come in: every field as text, some of them wrong by the key.
_FAULTS = (("age_numeric", 17, "'abc'"), ("time_in_hospital", 19, "'45'"), ("high_utilizer", 23, "'0.7'"),
           ("total_prior_visits", 29, "NULL"), ("num_procedures", 31, "'-1'"), ("gender", 37, "''"))


def requests(rows):
    """``rows`` (key and fields) as request texts with the faults planted."""
    fault = {f: (n, v) for f, n, v in _FAULTS}
    out = []
    for c in rows.columns:
        v = F.col(c).cast("string")
        if c in fault:
            v = F.when(F.col(KEY) % fault[c][0] == 0, F.expr(fault[c][1]).cast("string")).otherwise(v)
        out.append(F.col(c) if c == KEY else v.alias(c))
    return rows.select(*out)


@query("request_rejects")
def q_request_rejects(spark, sf_dir):
    """Accepted and rejected requests with the reasons (schema check of request texts)."""
    from riskloom.operators.quality import REQUEST_FIELDS, row_constraints
    from riskloom.plans.common import featured
    rows = featured(spark, sf_dir)
    names = [f[0] for f in REQUEST_FIELDS if f[0] in rows.columns]
    checked = row_constraints(requests(rows.select(KEY, *names)))
    reason = F.explode(F.when(F.size("violations") == 0, F.array(F.lit("accepted"))).otherwise(F.concat(F.array(F.lit("rejected")), F.col("violations"))))
    return checked.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _rejects_sql():
    from riskloom.operators.quality import REQUEST_FIELDS
    from riskloom.plans.sqlparts import with_features
    fault = {f: (n, v) for f, n, v in _FAULTS}
    texts, items = [KEY], []
    for name, typ, required, ge, le, default in REQUEST_FIELDS:
        t = f"CAST({name} AS VARCHAR)"
        if name in fault:
            t = f"CASE WHEN {KEY} % {fault[name][0]} = 0 THEN {fault[name][1]} ELSE {t} END"
        texts.append(f"{t} AS {name}")
        if typ != "string":
            d = f"TRY_CAST({name} AS DOUBLE)"
            v = f"CASE WHEN {d} = floor({d}) THEN {d} END" if typ == "int" else d
            items.append(f"CASE WHEN {name} IS NOT NULL AND ({v}) IS NULL THEN '{name}:type' END")
            if ge is not None:
                items.append(f"CASE WHEN ({v}) < {ge} THEN '{name}:ge' END")
            if le is not None:
                items.append(f"CASE WHEN ({v}) > {le} THEN '{name}:le' END")
        if required:
            items.append(f"CASE WHEN {name} IS NULL THEN '{name}:missing' END")
    return with_features(
        "SELECT unnest(CASE WHEN len(v) = 0 THEN ['accepted'] ELSE list_concat(['rejected'], v) END) AS reason, count(*) AS n FROM chk GROUP BY 1",
        f"req AS (SELECT {', '.join(texts)} FROM feat), chk AS (SELECT list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS v FROM req)")


oracle("request_rejects", _rejects_sql())


def _model_requests(spark, sf_dir):
    """The population's model inputs as request texts, and the model."""
    from riskloom.plans.q_model import _calibrated, prepared
    rm, _, _ = _calibrated(spark, sf_dir)
    d, names = prepared(spark, sf_dir)
    return requests(d.select(KEY, *names)), rm


@query("score_lenient")
def q_score_lenient(spark, sf_dir):
    """Score requests without validation: a field that is absent (here the last one),
    NULL or no number counts as 0.0."""
    reqs, rm = _model_requests(spark, sf_dir)
    reqs = reqs.drop(rm.features[-1])
    filled = reqs.select(KEY, *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in reqs.columns
                                else F.lit(0.0).alias(c) for c in rm.features])
    return rm.predict_proba(filled).select(KEY, F.round("score", 6).alias("score"))


#: Requests whose key this divides are sent twice.
_RESENT = 41


def _send(spark, reqs, base):
    """Request files of a stream: all requests with the time they were sent, then some again."""
    src = os.path.join(base, "requests")
    sent = reqs.withColumn("sent", F.timestamp_seconds(F.lit(1704067200) + F.col(KEY) % 300))
    sent.write.parquet(src)
    sent.where(F.col(KEY) % _RESENT == 0).write.mode("append").parquet(src)
    return src, sent.schema


@query("score_stream")
def q_score_stream(spark, sf_dir):
    """Structured Streaming answers to request files, some of them sent twice: valid rows with
    score, tier, base rate and factors as ``score_batch`` gives them, rejected rows with
    their violations, read back by their commits.  Every call is a run of its own."""
    from riskloom.streaming import commits as CM
    from riskloom.streaming.jobs import run_scoring
    reqs, _ = _model_requests(spark, sf_dir)
    rm, answer = _answers(spark, sf_dir)
    run = uuid.uuid4().hex
    base = scratch_path(spark, f"stream_{run}")
    src, schema = _send(spark, reqs, base)
    out = os.path.join(base, "out")

    def scored(valid):
        return answer(valid.select(KEY, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in valid.columns else F.lit(0.0).alias(n)
                                          for n in rm.features]))

    run_scoring(spark, src, schema, scored, out, KEY, name=f"scoring_{run}").awaitTermination()
    good = CM.read(spark, out, "answers").select(KEY, F.round("score", 6).alias("score"), "risk_tier", "base_rate", "expected", "top_factors")
    return good.unionByName(CM.read(spark, out, "rejects").select(KEY, "violations"), allowMissingColumns=True)


@query("request_rejects_stream")
def q_request_rejects_stream(spark, sf_dir):
    """``request_rejects`` of requests that come as a stream, some of them twice."""
    from riskloom.operators.quality import REQUEST_FIELDS
    from riskloom.plans.common import featured
    from riskloom.streaming import commits as CM
    from riskloom.streaming.jobs import run_scoring
    rows = featured(spark, sf_dir)
    names = [f[0] for f in REQUEST_FIELDS if f[0] in rows.columns]
    run = uuid.uuid4().hex
    base = scratch_path(spark, f"stream_{run}")
    src, schema = _send(spark, requests(rows.select(KEY, *names)), base)
    out = os.path.join(base, "out")
    run_scoring(spark, src, schema, lambda valid: valid.select(KEY), out, KEY, name=f"rejects_{run}").awaitTermination()
    bad = CM.read(spark, out, "rejects").select(F.explode(F.concat(F.array(F.lit("rejected")), F.col("violations"))).alias("reason"))
    return CM.read(spark, out, "answers").select(F.lit("accepted").alias("reason")).unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


oracle("request_rejects_stream", _rejects_sql())


# ---- the monitors as streams ---------------------------------------------------------------
def _stream_run(spark, sf_dir):
    from riskloom.sources.tables import table_path
    base = scratch_path(spark, f"monitor_{uuid.uuid4().hex}")
    return table_path(sf_dir, "events"), base


def _register_streams():
    from riskloom.plans.oracle import ORACLE
    from riskloom.streaming import jobs as J

    def windowed(monitor, batch_name):
        def fn(spark, sf_dir):
            src, base = _stream_run(spark, sf_dir)
            J.run_windowed(spark, monitor, _stream_source(spark, src, base), os.path.join(base, "out")).awaitTermination()
            return spark.read.parquet(os.path.join(base, "out"))
        fn.__doc__ = f"``{batch_name}`` as a stream run to the end of its input: its closed windows."
        query(f"{batch_name}_stream")(fn)
        body = ORACLE[batch_name]
        oracle(f"{batch_name}_stream", "SELECT * FROM (" + body + ") q WHERE window_start + INTERVAL 5 MINUTE <= "
               "(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE FROM events)")

    for m, b in (("latency", "latency_p95_p99"), ("score_buckets", "score_buckets"), ("error_rate", "error_rate")):
        windowed(m, b)

    @query("tier_totals_stream")
    def q_tier_totals_stream(spark, sf_dir):
        """Running tier totals as a stream of upserts; every tier's newest row."""
        src, base = _stream_run(spark, sf_dir)
        J.run_tier_totals(spark, _stream_source(spark, src, base), os.path.join(base, "out")).awaitTermination()
        return J.latest(spark, os.path.join(base, "out"), ["tier"])

    oracle("tier_totals_stream", ORACLE["tier_totals"])

    @query("batch_size_hist_stream")
    def q_batch_size_stream(spark, sf_dir):
        """Batch-size histogram of streamed running counts."""
        src, base = _stream_run(spark, sf_dir)
        J.run_batch_sizes(spark, _stream_source(spark, src, base), os.path.join(base, "out")).awaitTermination()
        return MON.size_hist(J.latest(spark, os.path.join(base, "out"), ["batch_id"]))

    oracle("batch_size_hist_stream", ORACLE["batch_size_hist"])


def _stream_source(spark, src, base):
    """A file stream reads folders: the events as a folder of their own."""
    out = os.path.join(base, "events")
    spark.read.parquet(src).write.parquet(out)
    return out


_register_streams()
