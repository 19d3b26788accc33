"""Registered queries: data-quality audits (2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import quality as Q
from riskloom.operators.cleaning import sentinel_to_null, with_binary_target
from riskloom.plans.common import featured
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import (ENC_COLS, ENC_STRING_COLS, SENTINEL_CTE, with_encounter,
                                     with_features)
from riskloom.sources.encounters import encounters

_CHECK = "'{c}' AS \"check\", '{s}' AS severity"


def _audit_row(check):
    def fn(spark, sf_dir):
        return Q.column_audit(encounters(spark, sf_dir)).where(F.col("check") == check) \
            .select("check", "severity", F.round("metric", 6).alias("metric"), "passed")
    return fn


def _miss(c):
    return f"({c} IS NULL OR {c} = '?')" if c in ENC_STRING_COLS else f"({c} IS NULL)"


_N_HIGH = " + ".join(f"CASE WHEN 100.0 * count_if({_miss(c)}) / count(*) > {C.HIGH_MISSING_PCT} "
                     f"THEN 1 ELSE 0 END" for c in ENC_COLS)
_RANGE_ROWS = [(c, lo, hi) for c, lo, hi in C.RANGE_CHECKS]

COLUMN_AUDIT_SQL = " UNION ALL ".join(
    [f"SELECT 'min_rows' AS \"check\", 'error' AS severity, cast(count(*) AS DOUBLE) AS metric, "
     f"count(*) >= {C.MIN_ROWS} AS passed FROM encounter",
     f"SELECT 'missing', 'warning', cast({_N_HIGH} AS DOUBLE), ({_N_HIGH}) = 0 FROM encounter"]
    + [f"SELECT 'range:{c}', 'warning', cast(count_if({c} < {lo} OR {c} > {hi}) AS DOUBLE), "
       f"count_if({c} < {lo} OR {c} > {hi}) = 0 FROM encounter" for c, lo, hi in _RANGE_ROWS]
    + ["SELECT 'class_balance', CASE WHEN avg(CASE WHEN readmitted IS NOT DISTINCT FROM '<30' "
       "THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'error' ELSE 'warning' END, "
       "round(avg(CASE WHEN readmitted IS NOT DISTINCT FROM '<30' THEN 1.0 ELSE 0.0 END), 6), "
       "avg(CASE WHEN readmitted IS NOT DISTINCT FROM '<30' THEN 1.0 ELSE 0.0 END) BETWEEN 0.05 AND 0.5 "
       "FROM encounter"])

for _key, _check in (("dq_min_rows", "min_rows"), ("dq_class_balance", "class_balance")):
    query(_key)(_audit_row(_check))
    oracle(_key, with_encounter(
        f"SELECT \"check\", severity, round(metric, 6) AS metric, passed "
        f"FROM ({COLUMN_AUDIT_SQL}) a WHERE \"check\" = '{_check}'"))


@query("dq_ranges")
def q_dq_ranges(spark, sf_dir):
    return Q.range_report(encounters(spark, sf_dir))


oracle("dq_ranges", with_encounter(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {lo} AS lo, {hi} AS hi, "
    f"count_if({c} < {lo} OR {c} > {hi}) AS n_out_of_range, "
    f"count_if({c} < {lo} OR {c} > {hi}) = 0 AS passed FROM encounter" for c, lo, hi in _RANGE_ROWS)))


@query("dq_missing")
def q_dq_missing(spark, sf_dir):
    return Q.missing_report(encounters(spark, sf_dir))


oracle("dq_missing", with_encounter(
    "SELECT \"column\", round(pct, 6) AS missing_pct, pct > 35.0 AS over_threshold, "
    "row_number() OVER (ORDER BY pct DESC, \"column\") AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 100.0 * count_if({_miss(c)}) / count(*) AS pct FROM encounter"
        for c in ENC_COLS) + ") m"))


@query("dq_duplicates")
def q_dq_duplicates(spark, sf_dir):
    return Q.duplicate_audit(encounters(spark, sf_dir), "encounter_id")


oracle("dq_duplicates", with_encounter(
    "SELECT 'duplicates' AS \"check\", 'warning' AS severity, cast(d AS DOUBLE) AS metric, "
    "d = 0 AS passed FROM (SELECT coalesce(sum(c - 1), 0) AS d FROM "
    "(SELECT encounter_id, count(*) AS c FROM encounter GROUP BY encounter_id) g) x"))


@query("dq_domain")
def q_dq_domain(spark, sf_dir):
    return Q.domain_audit(encounters(spark, sf_dir))


oracle("dq_domain", with_encounter(
    "SELECT 'target_domain' AS \"check\", 'error' AS severity, cast(count(*) AS DOUBLE) AS metric, "
    "count(*) = 0 AS passed FROM (SELECT DISTINCT readmitted FROM encounter "
    "WHERE readmitted IS NULL OR readmitted NOT IN ('<30', '>30', 'NO')) u"))


@query("domain_diff")
def q_domain_diff(spark, sf_dir):
    return Q.domain_diff(encounters(spark, sf_dir))


oracle("domain_diff", with_encounter(
    "SELECT readmitted AS value, count(*) AS n FROM encounter "
    "WHERE readmitted IS NULL OR readmitted NOT IN ('<30', '>30', 'NO') GROUP BY readmitted"))

_NUMERIC = [c for c in ENC_COLS if c not in ENC_STRING_COLS]


@query("dq_leakage")
def q_dq_leakage(spark, sf_dir):
    d = with_binary_target(sentinel_to_null(encounters(spark, sf_dir)))
    return Q.leakage_audit(d, C.TARGET_COL, label=C.LABEL_COL)


_HI_CORR = " + ".join(
    f"CASE WHEN coalesce(abs(corr(cast({c} AS DOUBLE), cast(readmitted_30d AS DOUBLE))) >= 0.99, false) "
    f"THEN 1 ELSE 0 END" for c in _NUMERIC)
oracle("dq_leakage", with_encounter(
    "SELECT 'leakage:name' AS \"check\", 'error' AS severity, 0.0e0 AS metric, true AS passed "
    "UNION ALL SELECT 'leakage:corr', 'error', cast(" + _HI_CORR + " AS DOUBLE), (" + _HI_CORR
    + ") = 0 FROM sentinel "
    "UNION ALL SELECT 'leakage:purity', 'warning', cast(count(*) AS DOUBLE), count(*) = 0 FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c} AS v FROM sentinel WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= {Q.PURE_ROWS} "
        "AND sum(readmitted_30d) IN (0, count(*))" for c in ENC_STRING_COLS if c != C.TARGET_COL) + ") p", SENTINEL_CTE))


@query("dq_report")
def q_dq_report(spark, sf_dir):
    # two passes (key duplicates, the one-pass column audit) read the derived input
    r = Q.dq_report(encounters(spark, sf_dir).cache())
    return r.select("check", "severity", F.round("metric", 6).alias("metric"), "passed")


_ALL_CHECKS = (
    "SELECT 'target_domain' AS \"check\", 'error' AS severity, cast(count(*) AS DOUBLE) AS metric, "
    "count(*) = 0 AS passed FROM (SELECT DISTINCT readmitted FROM encounter WHERE readmitted IS NULL "
    "OR readmitted NOT IN ('<30', '>30', 'NO')) u "
    "UNION ALL SELECT 'leakage:name', 'error', 0.0e0, true "
    "UNION ALL SELECT 'duplicates', 'warning', cast(d AS DOUBLE), d = 0 FROM (SELECT "
    "coalesce(sum(c - 1), 0) AS d FROM (SELECT encounter_id, count(*) AS c FROM encounter "
    "GROUP BY encounter_id) g) x UNION ALL " + COLUMN_AUDIT_SQL)
oracle("dq_report", with_encounter(
    "SELECT \"check\", severity, round(metric, 6) AS metric, passed FROM checks UNION ALL "
    "SELECT 'verdict', 'error', cast(sum(CASE WHEN severity = 'error' AND NOT passed THEN 1 ELSE 0 END) "
    "AS DOUBLE), sum(CASE WHEN severity = 'error' AND NOT passed THEN 1 ELSE 0 END) = 0 FROM checks",
    f"checks AS ({_ALL_CHECKS})"))


@query("row_constraints")
def q_row_constraints(spark, sf_dir):
    checked = Q.row_constraints(featured(spark, sf_dir))
    # violations and valid rows from one pass; "valid" is there without such rows too
    found = F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(F.col("violations"))
    n = checked.select(F.explode(found).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
    none = spark.createDataFrame([("valid", 0)], "violation string, n long")
    return n.unionByName(none).groupBy("violation").agg(F.sum("n").alias("n"))


def _constraint_sql():
    items = []
    for name, typ, required, ge, le, default in Q.REQUEST_FIELDS:
        v = name if default is None or typ == "string" else f"coalesce({name}, {default})"
        if required:
            items.append(f"CASE WHEN {name} IS NULL THEN '{name}:missing' END")
        if ge is not None:
            items.append(f"CASE WHEN {v} < {ge} THEN '{name}:ge' END")
        if le is not None:
            items.append(f"CASE WHEN {v} > {le} THEN '{name}:le' END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


oracle("row_constraints", with_features(
    "SELECT violation, count(*) AS n FROM (SELECT unnest(v) AS violation FROM chk) e GROUP BY violation "
    "UNION ALL SELECT 'valid', count_if(len(v) = 0) FROM chk",
    f"chk AS (SELECT {_constraint_sql()} AS v FROM feat)"))
