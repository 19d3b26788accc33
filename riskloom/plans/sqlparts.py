"""SQL text for the DuckDB oracle: the derived inputs as CTEs plus scalar helpers.

Portability rules: ``||`` instead of ``concat``; integer sums cast to BIGINT;
doubles rounded to 6 dp; every ordering has a key tie-break.
"""

from __future__ import annotations

from riskloom import config as C


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def age_numeric_sql(c: str = "age") -> str:
    whens = " ".join(f"WHEN {c} = '{b}' THEN {i}" for i, b in enumerate(C.AGE_BRACKETS))
    return f"(CASE {whens} ELSE 0 END)"


def age_bucket_sql(c: str = "age") -> str:
    n = age_numeric_sql(c)
    return (f"(CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {n} <= 2 THEN 'Young' "
            f"WHEN {n} <= 5 THEN 'Middle' ELSE 'Elderly' END)")


def gender_sql(c: str = "gender") -> str:
    return f"(CASE WHEN {c} = 'Male' THEN 0 WHEN {c} = 'Female' THEN 1 ELSE -1 END)"


def icd_sql(c: str) -> str:
    stripped = f"trim({c})"
    num = f"try_cast(split_part({stripped}, '.', 1) AS DOUBLE)"
    ranges = " ".join(f"WHEN {num} >= {lo} AND {num} <= {hi} THEN '{name}'"
                      for lo, hi, name in C.ICD_RANGES)
    return (f"(CASE WHEN {c} IS NULL OR {c} IN ({sql_list(C.ICD_OTHER_TOKENS)}) THEN 'Other' "
            f"WHEN starts_with({stripped}, 'V') OR starts_with({stripped}, 'E') THEN 'External' "
            f"{ranges} ELSE 'Other' END)")


def tier_sql(s: str, p25: str, p50: str, p75: str) -> str:
    return (f"(CASE WHEN {s} < {p25} THEN 'Low' WHEN {s} < {p50} THEN 'Medium' "
            f"WHEN {s} < {p75} THEN 'High' ELSE 'Critical' END)")


def tier_no_sql(t: str) -> str:
    return "(CASE " + " ".join(f"WHEN {t} = '{n}' THEN {i}" for i, n in enumerate(C.TIER_NAMES)) \
        + " END)"


_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_PRIOR = f"OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

BASE_CTES = f"""
li AS (
  SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts,
         cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret,
         min(l_partkey) AS p1, max(l_partkey) AS p2
  FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
         lead(o_orderdate) OVER ({_WIN}) AS nx,
         cast(count(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 1 END) {_PRIOR} AS BIGINT) AS n_out,
         cast(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) {_PRIOR} AS BIGINT) AS n_emg,
         cast(count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) {_PRIOR} AS BIGINT) AS n_inp
  FROM orders),
b AS (
  SELECT * FROM o JOIN customer ON o_custkey = c_custkey
  LEFT JOIN li ON o_orderkey = l_orderkey)"""

_AGE = ("'[' || cast((o_custkey * 7 % 10) * 10 AS VARCHAR) || '-' || "
        "cast((o_custkey * 7 % 10) * 10 + 10 AS VARCHAR) || ')'")
_GENDER = ("CASE WHEN o_custkey % 101 = 0 THEN 'Unknown/Invalid' WHEN o_custkey % 2 = 0 "
           "THEN 'Male' ELSE 'Female' END")
_DIAG1 = ("CASE WHEN p1 % 17 = 0 THEN 'V' || cast(p1 % 90 AS VARCHAR) "
          "WHEN p1 % 19 = 0 THEN 'E' || cast(p1 % 999 AS VARCHAR) "
          "WHEN p1 % 23 = 0 THEN '?' ELSE cast(p1 % 1000 AS VARCHAR) END")
_DDIFF = "date_diff('day', cast(o_orderdate AS DATE), cast(nx AS DATE))"

ENCOUNTER_CTE = f"""
encounter AS (
  SELECT o_orderkey AS encounter_id,
    o_custkey AS patient_nbr,
    CASE WHEN o_custkey % 50 = 0 THEN '?' ELSE c_mktsegment END AS race,
    {_GENDER} AS gender,
    {_AGE} AS age,
    CASE WHEN o_orderkey % 30 = 0 THEN '[75-100)' ELSE '?' END AS weight,
    CASE WHEN o_custkey % 3 = 0 THEN '?' ELSE 'MC' END AS payer_code,
    'No' AS examide, 'No' AS citoglipton, 'No' AS troglitazone,
    cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS admission_type_id,
    1 + o_custkey % 5 AS discharge_disposition_id,
    1 + o_orderkey % 7 AS admission_source_id,
    1 + o_orderkey % 14 AS time_in_hospital,
    1 + (o_orderkey * 13) % 100 AS num_lab_procedures,
    n_ret AS num_procedures,
    n_parts AS num_medications,
    n_lines AS number_diagnoses,
    cast(coalesce(n_out, 0) AS BIGINT) AS number_outpatient,
    cast(coalesce(n_emg, 0) AS BIGINT) AS number_emergency,
    cast(coalesce(n_inp, 0) AS BIGINT) AS number_inpatient,
    {_DIAG1} AS diag_1,
    cast(p2 % 1000 AS VARCHAR) || '.' || cast(p2 % 100 AS VARCHAR) AS diag_2,
    CASE WHEN (p1 + p2) % 29 = 0 THEN 'V' WHEN (p1 + p2) % 31 = 0 THEN 'x12'
         ELSE cast((p1 + p2) % 1100 AS VARCHAR) END AS diag_3,
    CASE WHEN o_orderkey % 6 = 0 THEN '>8' WHEN o_orderkey % 6 = 1 THEN '>7'
         WHEN o_orderkey % 6 = 2 THEN 'Norm' WHEN o_orderkey % 6 = 3 THEN '?' ELSE 'None' END AS A1Cresult,
    CASE WHEN o_orderkey % 8 = 0 THEN '>300' WHEN o_orderkey % 8 = 1 THEN '>200'
         WHEN o_orderkey % 8 = 2 THEN 'Norm' ELSE 'None' END AS max_glu_serum,
    CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'Steady' WHEN 1 THEN 'Up' WHEN 2 THEN '?' ELSE 'No' END AS metformin,
    CASE (o_orderkey * 5 + o_custkey) % 7 WHEN 0 THEN 'Steady' WHEN 1 THEN 'Down' ELSE 'No' END AS glipizide,
    CASE (o_orderkey * 3 + o_custkey) % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'Steady' WHEN 2 THEN 'Up' ELSE 'Down' END AS insulin,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Ch' ELSE 'No' END AS change,
    CASE WHEN o_custkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS diabetesMed,
    CASE WHEN nx IS NULL THEN 'NO' WHEN {_DDIFF} < 30 THEN '<30' ELSE '>30' END AS readmitted
  FROM b)"""

SCORED_CTE = f"""
scored AS (
  SELECT o_orderkey AS encounter_id,
    CASE WHEN nx IS NOT NULL AND {_DDIFF} < 30 THEN 1 ELSE 0 END AS label,
    least(999, (o_orderkey * 7919) % 700 + 100 * coalesce(n_inp, 0)) AS score_milli,
    least(999, (o_orderkey * 7919) % 700 + 100 * coalesce(n_inp, 0)) / 1000.0e0 AS score,
    {age_bucket_sql('(' + _AGE + ')')} AS age_risk_bucket,
    {gender_sql('(' + _GENDER + ')')} AS gender,
    {icd_sql('(' + "nullif(" + _DIAG1 + ", '?')" + ')')} AS diag_1_category
  FROM b)"""

PREDICTION_LOG_CTE = """
plog AS (
  SELECT event_id AS request_id, cast(ts AS TIMESTAMP) AS ts, event_type AS endpoint,
         event_type = 'error' AS is_error, least(value, 100.0e0) / 100.0e0 AS risk_score,
         value / 200.0e0 AS latency_s, user_id AS batch_id
  FROM events)"""


def with_encounter(body: str, extra: str = "") -> str:
    return f"WITH {BASE_CTES},{ENCOUNTER_CTE}{(',' + extra) if extra else ''}\n{body}"


def with_scored(body: str, extra: str = "") -> str:
    return f"WITH {BASE_CTES},{SCORED_CTE}{(',' + extra) if extra else ''}\n{body}"


def with_both(body: str, extra: str = "") -> str:
    return f"WITH {BASE_CTES},{ENCOUNTER_CTE},{SCORED_CTE}{(',' + extra) if extra else ''}\n{body}"


def with_plog(body: str, extra: str = "") -> str:
    return f"WITH {PREDICTION_LOG_CTE}{(',' + extra) if extra else ''}\n{body}"


# ---- cleaned + featured encounter (static column decisions, checked
#      dynamically by the drop_high_missing / drop_constant queries) ----------
ENC_STRING_COLS = ("race", "gender", "age", "weight", "payer_code", "examide", "citoglipton",
                   "troglitazone", "diag_1", "diag_2", "diag_3", "A1Cresult", "max_glu_serum",
                   "metformin", "glipizide", "insulin", "change", "diabetesMed", "readmitted")
ENC_COLS = ("encounter_id", "patient_nbr", "race", "gender", "age", "weight", "payer_code",
            "examide", "citoglipton", "troglitazone", "admission_type_id",
            "discharge_disposition_id", "admission_source_id", "time_in_hospital",
            "num_lab_procedures", "num_procedures", "num_medications", "number_diagnoses",
            "number_outpatient", "number_emergency", "number_inpatient", "diag_1", "diag_2",
            "diag_3", "A1Cresult", "max_glu_serum", "metformin", "glipizide", "insulin",
            "change", "diabetesMed", "readmitted")
# After cleaning the encounter fixture: configured drops, 'weight' (>35% missing),
# 'troglitazone' and 'payer_code' (one distinct non-NULL value once '?' is NULL).
# encounter_id is carried as the row key.
CLEAN_DROPPED = ("patient_nbr", "readmitted", "examide", "citoglipton", "weight", "troglitazone",
                 "payer_code")
CLEAN_COLS = tuple(c for c in ENC_COLS if c not in CLEAN_DROPPED)
MEDS_PRESENT = ("metformin", "glipizide", "insulin")


def nulled_sql(c: str) -> str:
    return f"nullif({c}, '?') AS {c}" if c in ENC_STRING_COLS else c


SENTINEL_CTE = ("sentinel AS (SELECT " + ", ".join(nulled_sql(c) for c in ENC_COLS)
                + ", CASE WHEN readmitted IS NOT DISTINCT FROM '<30' THEN 1 ELSE 0 END"
                  " AS readmitted_30d FROM encounter)")
CLEANED_CTE = ("cleaned AS (SELECT " + ", ".join(CLEAN_COLS) + ", readmitted_30d FROM sentinel)")


def _flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def feature_exprs(src_has_params: bool = True) -> list[tuple[str, str]]:
    """(name, SQL) of every derived feature over ``cleaned`` columns; uses
    ``prm.q75`` and ``prm.med`` when fitted parameters are joined."""
    tpv = "(coalesce(number_outpatient, 0) + coalesce(number_emergency, 0) + coalesce(number_inpatient, 0))"
    cx = "(coalesce(num_procedures, 0) + coalesce(number_diagnoses, 0) + coalesce(num_medications, 0))"
    nmeds = "(" + " + ".join(_flag(f"{m} IS NOT NULL AND {m} <> 'No'") for m in MEDS_PRESENT) + ")"
    a1c_t = _flag("A1Cresult IS DISTINCT FROM 'None'")
    glu_t = _flag("max_glu_serum IS DISTINCT FROM 'None'")
    agen = age_numeric_sql("age")
    return [
        ("age_numeric", agen),
        ("age_risk_bucket", age_bucket_sql("age")),
        ("gender", gender_sql("gender")),
        ("total_prior_visits", tpv),
        ("high_utilizer", _flag(f"{tpv} > prm.q75") if src_has_params else "0"),
        ("has_number_outpatient", _flag("number_outpatient > 0")),
        ("has_number_emergency", _flag("number_emergency > 0")),
        ("has_number_inpatient", _flag("number_inpatient > 0")),
        ("clinical_complexity", cx),
        ("days_per_diagnosis", "time_in_hospital / (number_diagnoses + 1)"),
        ("procedure_intensity", "num_procedures / (time_in_hospital + 1)"),
        ("lab_intensity", "num_lab_procedures / (time_in_hospital + 1)"),
        ("a1c_tested", a1c_t),
        ("a1c_high", _flag("A1Cresult IN ('>7', '>8')")),
        ("a1c_very_high", _flag("A1Cresult = '>8'")),
        ("glucose_tested", glu_t),
        ("glucose_high", _flag("max_glu_serum IN ('>200', '>300')")),
        ("both_labs_done", f"({a1c_t} * {glu_t})"),
        ("n_active_medications", nmeds),
        ("any_insulin", _flag("insulin IN ('Up', 'Down', 'Steady')")),
        ("insulin_increased", _flag("insulin = 'Up'")),
        ("insulin_decreased", _flag("insulin = 'Down'")),
        ("any_med_change", _flag("change = 'Ch'")),
        ("on_diabetes_med", _flag("diabetesMed = 'Yes'")),
        ("diag_1_category", icd_sql("diag_1")),
        ("diag_2_category", icd_sql("diag_2")),
        ("diag_3_category", icd_sql("diag_3")),
        ("primary_diag_high_risk", _flag(f"{icd_sql('diag_1')} IN ({sql_list(C.HIGH_RISK_DIAG)})")),
        ("age_x_ndiagnoses", f"{agen} * number_diagnoses"),
        ("n_meds_x_ndiagnoses", f"{nmeds} * number_diagnoses"),
        ("inpatient_x_emergency", "number_inpatient * number_emergency"),
        ("elderly_high_complexity",
         f"{_flag(f'{agen} >= 6')} * {_flag(f'{cx} > prm.med')}" if src_has_params else "0"),
    ]


FEATURE_NAMES = [n for n, _ in feature_exprs()]
RAW_KEPT = tuple(c for c in CLEAN_COLS if c not in ("age", "gender", "diag_1", "diag_2", "diag_3"))
PARAMS_CTE = """prm AS (
  SELECT quantile_cont(coalesce(number_outpatient, 0) + coalesce(number_emergency, 0)
                       + coalesce(number_inpatient, 0), 0.75) AS q75,
         quantile_cont(coalesce(num_procedures, 0) + coalesce(number_diagnoses, 0)
                       + coalesce(num_medications, 0), 0.5) AS med
  FROM cleaned)"""
FEAT_CTE = ("feat AS (SELECT " + ", ".join(RAW_KEPT) + ", readmitted_30d, "
            + ", ".join(f"{e} AS {n}" for n, e in feature_exprs())
            + " FROM cleaned CROSS JOIN prm)")


def with_features(body: str, extra: str = "") -> str:
    return with_encounter(body, f"{SENTINEL_CTE},\n{CLEANED_CTE},\n{PARAMS_CTE},\n{FEAT_CTE}"
                          + (",\n" + extra if extra else ""))


def with_cleaned(body: str, extra: str = "") -> str:
    return with_encounter(body, f"{SENTINEL_CTE},\n{CLEANED_CTE}" + (",\n" + extra if extra else ""))


# ---- train-fitted feature pipeline (split → features → encode → impute) ----------
PIPE_CATS = ("race", "A1Cresult", "max_glu_serum", "metformin", "glipizide", "insulin", "change",
             "diabetesMed", "age_risk_bucket", "diag_1_category", "diag_2_category",
             "diag_3_category")
PIPE_NUMS = tuple([c for c in RAW_KEPT if c != "encounter_id"] + FEATURE_NAMES)


def pipeline_ctes(split_sql_text: str) -> str:
    """CTEs ending in ``enc`` (ordinal-encoded) and ``imp`` (median-imputed)."""
    prm_train = PARAMS_CTE.replace("FROM cleaned)", "FROM cs WHERE split = 'train')")
    feat = ("featp AS (SELECT " + ", ".join(RAW_KEPT) + ", readmitted_30d, split, "
            + ", ".join(f"{e} AS {n}" for n, e in feature_exprs()) + " FROM cs CROSS JOIN prm)")
    codes = []
    for c in PIPE_CATS:
        codes.append(
            f"code_{c} AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM "
            f"(SELECT DISTINCT {c} AS value FROM featp WHERE split = 'train' AND {c} IS NOT NULL) d)")
    nul = ("trnull AS (SELECT " + ", ".join(
        f"count_if({c} IS NULL) > 0 AS {c}" for c in PIPE_CATS) + " FROM featp WHERE split = 'train')")
    sel = []
    for c in PIPE_NUMS:
        if c in PIPE_CATS:
            sel.append(f"CASE WHEN f.{c} IS NULL THEN CASE WHEN trnull.{c} THEN NULL ELSE -1.0 END "
                       f"ELSE coalesce(cast(code_{c}.code AS DOUBLE), -1.0) END AS {c}")
        else:
            sel.append(f"cast(f.{c} AS DOUBLE) AS {c}")
    joins = " ".join(f"LEFT JOIN code_{c} ON f.{c} = code_{c}.value" for c in PIPE_CATS)
    enc = (f"enc AS (SELECT f.encounter_id, f.split, f.readmitted_30d, " + ", ".join(sel)
           + f" FROM featp f CROSS JOIN trnull {joins})")
    med = "med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in PIPE_NUMS) + \
        " FROM enc WHERE split = 'train')"
    imp = ("imp AS (SELECT encounter_id, split, readmitted_30d, " + ", ".join(
        f"coalesce(enc.{c}, med.{c}) AS {c}" for c in PIPE_NUMS) + " FROM enc CROSS JOIN med)")
    return ",\n".join([split_sql_text.strip(),
                       "cs AS (SELECT c.*, s.split FROM cleaned c JOIN splitted s USING (encounter_id))",
                       prm_train, feat, *codes, nul, enc, med, imp])


def with_pipeline(body: str, split_sql_text: str, extra: str = "") -> str:
    return with_cleaned(body, pipeline_ctes(split_sql_text) + (",\n" + extra if extra else ""))
