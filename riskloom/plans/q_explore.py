"""Registered queries: subgroup fairness and exploratory aggregates (2.10)."""

from __future__ import annotations

import uuid

from riskloom import config as C
from riskloom.functions.exprs import linspace
from riskloom.operators import explore as E
from riskloom.operators import sketches as SK
from riskloom.operators import strata as S
from riskloom.operators.cleaning import sentinel_to_null, with_binary_target
from riskloom.plans.oracle import ORACLE, oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import (ENC_COLS, ENC_STRING_COLS, SENTINEL_CTE, with_encounter,
                                     with_scored)
from riskloom.session import scratch_path
from riskloom.sources.encounters import encounters, scored

LABEL = C.LABEL_COL
_CATS = [c for c in ENC_STRING_COLS if c != "readmitted"]
_NUMS = [c for c in ENC_COLS if c not in ENC_STRING_COLS and c not in ("encounter_id", "patient_nbr")]


def _sentinel(spark, sf_dir):
    return with_binary_target(sentinel_to_null(encounters(spark, sf_dir)))


# ---- fairness ------------------------------------------------------------------------
_SUB_LONG = " UNION ALL ".join(
    f"SELECT '{d}' AS dim, cast({d} AS VARCHAR) AS grp, label, score, encounter_id FROM scored"
    for d in C.SUBGROUP_COLS)
_SUB_SQL = f"""sub AS (
  SELECT dim, grp, count(*) AS n, sum(label) AS p,
         CASE WHEN sum(label) > 0 AND sum(label) < count(*)
              THEN (sum(CASE WHEN label = 1 THEN mr END) - sum(label) * (sum(label) + 1) / 2.0)
                   / (sum(label) * (count(*) - sum(label))) END AS auc
  FROM (SELECT *, avg(rn) OVER (PARTITION BY dim, grp, score) AS mr
        FROM (SELECT *, row_number() OVER (PARTITION BY dim, grp ORDER BY score, encounter_id) AS rn
              FROM ({_SUB_LONG}) l) r) m
  GROUP BY dim, grp HAVING count(*) >= {C.SUBGROUP_MIN_N} AND sum(label) >= {C.SUBGROUP_MIN_POS})"""


@query("subgroup_auc")
def q_subgroup_auc(spark, sf_dir):
    return S.subgroup_auc(scored(spark, sf_dir))


oracle("subgroup_auc", with_scored(
    "SELECT dim, grp AS \"group\", n, round(p / n, 6) AS pos_rate, round(auc, 6) AS auc_roc FROM sub",
    _SUB_SQL))


@query("subgroup_gap")
def q_subgroup_gap(spark, sf_dir):
    return S.subgroup_gap(scored(spark, sf_dir))


oracle("subgroup_gap", with_scored(
    "SELECT dim, round(min(round(auc, 6)), 6) AS min_auc, "
    "round(max(round(auc, 6)) - min(round(auc, 6)), 6) AS max_gap FROM sub GROUP BY dim", _SUB_SQL))


# ---- EDA --------------------------------------------------------------------------------
@query("rate_by_category")
def q_rate_by_category(spark, sf_dir):
    return E.rate_by_category(_sentinel(spark, sf_dir), _CATS, LABEL)


oracle("rate_by_category", with_encounter(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, round(avg({LABEL}), 6) AS rate, "
        f"round((SELECT avg({LABEL}) FROM sentinel), 6) AS overall_rate FROM sentinel GROUP BY {c}"
        for c in _CATS), SENTINEL_CTE))


@query("value_counts")
def q_value_counts(spark, sf_dir):
    return E.value_counts(encounters(spark, sf_dir), C.TARGET_COL)


oracle("value_counts", with_encounter(
    "SELECT readmitted AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) "
    "AS proportion FROM encounter GROUP BY readmitted"))


@query("cardinality_top3")
def q_cardinality(spark, sf_dir):
    return E.cardinality_top(_sentinel(spark, sf_dir), _CATS, 3)


oracle("cardinality_top3", with_encounter(
    "SELECT \"column\", value, n, rank, n_unique FROM (SELECT *, row_number() OVER "
    "(PARTITION BY \"column\" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY \"column\") "
    "AS n_unique FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM sentinel WHERE {c} IS NOT NULL "
        f"GROUP BY {c}" for c in _CATS) + ") v) r WHERE rank <= 3", SENTINEL_CTE))


@query("cardinality_sketches")
def q_cardinality_sketches(spark, sf_dir):
    """``cardinality_top3`` from sketches stored per part of the input (here the admission
    type), merged; exact for columns of few values, as these are."""
    path = scratch_path(spark, f"sketches_{uuid.uuid4().hex}")
    SK.store(SK.column_sketches(_sentinel(spark, sf_dir), _CATS, "admission_type_id"), path)
    return SK.estimates(SK.merge(SK.stored(spark, path)), 3)


oracle("cardinality_sketches", ORACLE["cardinality_top3"])


@query("null_counts")
def q_null_counts(spark, sf_dir):
    return E.null_counts(sentinel_to_null(encounters(spark, sf_dir)))


oracle("null_counts", with_encounter(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS nulls FROM sentinel" for c in ENC_COLS)
    + ") x WHERE nulls > 0", SENTINEL_CTE))


@query("histogram")
def q_histogram(spark, sf_dir):
    return E.histogram(encounters(spark, sf_dir), _NUMS, 30)


def _hist_sql():
    parts = []
    for c in _NUMS:
        inner = " + ".join(f"CASE WHEN {c} >= lo + {i} * ((hi - lo) / 30.0) THEN 1 ELSE 0 END"
                           for i in range(1, 30))
        parts.append(
            f"SELECT '{c}' AS \"column\", least({inner}, 29) AS bin, count(*) AS count FROM encounter "
            f"CROSS JOIN (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo, "
            f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM encounter) r "
            f"WHERE {c} IS NOT NULL GROUP BY 1, 2")
    return " UNION ALL ".join(parts)


oracle("histogram", with_encounter(_hist_sql()))

_CORR_COLS = _NUMS + [LABEL]


@query("correlation_matrix")
def q_corr(spark, sf_dir):
    return E.correlation_matrix(_sentinel(spark, sf_dir), _CORR_COLS)


oracle("correlation_matrix", with_encounter(
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(cast({a} AS DOUBLE), cast({b} AS DOUBLE)), 6) "
        f"AS corr FROM sentinel" for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[:i]),
    SENTINEL_CTE))

_BOX = ["time_in_hospital", "num_lab_procedures", "num_medications", "number_diagnoses"]


@query("box_stats")
def q_box(spark, sf_dir):
    return E.box_stats(_sentinel(spark, sf_dir), _BOX, LABEL)


oracle("box_stats", with_encounter(
    f"""SELECT "column", {LABEL}, round(min(v), 6) AS min, round(q1, 6) AS q1, round(med, 6) AS median,
           round(q3, 6) AS q3, round(max(v), 6) AS max,
           round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 6) AS whisker_lo,
           round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_hi
    FROM (SELECT *, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.5) OVER w AS med,
                 quantile_cont(v, 0.75) OVER w AS q3
          FROM ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {LABEL}, cast({c} AS DOUBLE) AS v FROM sentinel WHERE {c} IS NOT NULL" for c in _BOX)}) l
          WINDOW w AS (PARTITION BY "column", {LABEL})) x
    GROUP BY "column", {LABEL}, q1, med, q3""", SENTINEL_CTE))


@query("column_profile")
def q_profile(spark, sf_dir):
    return E.column_profile(encounters(spark, sf_dir))


def _profile_sql():
    parts = []
    for c in ENC_COLS:
        typ = "string" if c in ENC_STRING_COLS else ("int" if c == "admission_type_id" else "bigint")
        parts.append(
            f"SELECT '{c}' AS \"column\", '{typ}' AS type, count(*) AS rows, count_if({c} IS NULL) AS nulls, "
            f"count(DISTINCT {c}) AS distinct, cast(min({c}) AS VARCHAR) AS min, "
            f"cast(max({c}) AS VARCHAR) AS max FROM encounter")
    return " UNION ALL ".join(parts)


oracle("column_profile", with_encounter(_profile_sql()))
