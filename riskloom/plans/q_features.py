"""Registered queries: cleaning (2.3), feature derivation (2.4), splits and
encoders (2.5), ingest (2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions import exprs as X
from riskloom.operators import cleaning as K
from riskloom.operators.features import FeatureEngineer, FeatureModel
from riskloom.operators.split import stratified_split
from riskloom.plans.common import cleaned, featured, r6
from riskloom.plans.oracle import oracle
from riskloom.plans.registry import query
from riskloom.plans.sqlparts import (CLEAN_COLS, ENC_COLS, ENC_STRING_COLS, SENTINEL_CTE,
                                     feature_exprs, icd_sql, nulled_sql, with_cleaned, with_scored,
                                     with_encounter, with_features)
from riskloom.sources.encounters import encounters

KEY = "encounter_id"
LABEL = C.LABEL_COL


# ---- 2.1 ingest ---------------------------------------------------------------
@query("ingest_merge")
def q_ingest_merge(spark, sf_dir):
    """Attach the target table to the feature table on the row key."""
    enc = encounters(spark, sf_dir)
    feats = enc.drop(C.TARGET_COL)
    targets = enc.select(KEY, C.TARGET_COL)
    return feats.join(targets, KEY)


oracle("ingest_merge", with_encounter("SELECT * FROM encounter"))


# ---- 2.3 cleaning --------------------------------------------------------------
@query("sentinel_to_null")
def q_sentinel_to_null(spark, sf_dir):
    return K.sentinel_to_null(encounters(spark, sf_dir))


oracle("sentinel_to_null", with_encounter(
    "SELECT " + ", ".join(nulled_sql(c) for c in ENC_COLS) + " FROM encounter"))


@query("binary_target")
def q_binary_target(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(KEY, C.TARGET_COL, X.binary_target().alias(LABEL))


oracle("binary_target", with_encounter(
    f"SELECT {KEY}, readmitted, CASE WHEN readmitted IS NOT DISTINCT FROM '<30' THEN 1 ELSE 0 END "
    f"AS {LABEL} FROM encounter"))


@query("drop_columns")
def q_drop_columns(spark, sf_dir):
    return K.drop_columns(encounters(spark, sf_dir), C.DROP_COLUMNS)


oracle("drop_columns", with_encounter(
    "SELECT " + ", ".join(c for c in ENC_COLS if c not in C.DROP_COLUMNS) + " FROM encounter"))


def _after_target(spark, sf_dir):
    d = K.with_binary_target(K.sentinel_to_null(encounters(spark, sf_dir)))
    return K.drop_columns(d, C.DROP_COLUMNS, keep=(KEY,))


_AFTER_TARGET_COLS = [c for c in ENC_COLS if c not in C.DROP_COLUMNS or c == KEY] + [LABEL]


@query("drop_high_missing")
def q_drop_high_missing(spark, sf_dir):
    prof = K.missing_profile(_after_target(spark, sf_dir), exclude=(KEY,))
    return prof.select("column", F.round("missing_pct", 6).alias("missing_pct"),
                       (F.col("missing_pct") > C.HIGH_MISSING_PCT).alias("dropped"))


oracle("drop_high_missing", with_encounter(
    "SELECT \"column\", round(p, 6) AS missing_pct, p > 35.0 AS dropped FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 100.0 * count_if({c} IS NULL) / count(*) AS p FROM sentinel"
        for c in _AFTER_TARGET_COLS if c != KEY) + ") x", SENTINEL_CTE))


@query("drop_constant")
def q_drop_constant(spark, sf_dir):
    return K.constant_profile(_after_target(spark, sf_dir), exclude=(KEY,), max_missing=C.HIGH_MISSING_PCT)


oracle("drop_constant", with_encounter(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(min({c}) = max({c}), true) AS is_constant FROM sentinel"
        for c in _AFTER_TARGET_COLS if c not in (KEY, "weight")), SENTINEL_CTE))


@query("clean")
def q_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


oracle("clean", with_cleaned("SELECT * FROM cleaned"))


@query("drop_null_rows")
def q_drop_null_rows(spark, sf_dir):
    return K.drop_null_rows(cleaned(spark, sf_dir))


oracle("drop_null_rows", with_cleaned(
    "SELECT * FROM cleaned WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CLEAN_COLS)))


@query("filter_by_class")
def q_filter_by_class(spark, sf_dir):
    """Scores of the positive class (a mask on the label)."""
    from riskloom.sources.encounters import scored
    return scored(spark, sf_dir, with_groups=False).where(F.col("label") == 1) \
        .select("encounter_id", "score")


oracle("filter_by_class", with_scored("SELECT encounter_id, score FROM scored WHERE label = 1"))


# ---- 2.4 feature derivation -----------------------------------------------------
_GROUPS = {
    "feat_demographic": ["age_numeric", "age_risk_bucket", "gender"],
    "feat_admission": ["total_prior_visits", "high_utilizer", "has_number_outpatient",
                       "has_number_emergency", "has_number_inpatient"],
    "feat_clinical": ["clinical_complexity", "days_per_diagnosis", "procedure_intensity",
                      "lab_intensity"],
    "feat_lab": ["a1c_tested", "a1c_high", "a1c_very_high", "glucose_tested", "glucose_high",
                 "both_labs_done"],
    "feat_medication": ["n_active_medications", "any_insulin", "insulin_increased",
                        "insulin_decreased", "any_med_change", "on_diabetes_med"],
    "feat_diagnosis": ["diag_1_category", "diag_2_category", "diag_3_category",
                       "primary_diag_high_risk"],
    "feat_interaction": ["age_x_ndiagnoses", "n_meds_x_ndiagnoses", "inpatient_x_emergency",
                         "elderly_high_complexity"],
}
_NEEDS_FIT = {"feat_admission", "feat_interaction"}
_FEXPR = dict(feature_exprs())


def _group_query(name, cols):
    def fn(spark, sf_dir):
        c = cleaned(spark, sf_dir)
        if name in _NEEDS_FIT:
            model = FeatureEngineer().fit(c)
        else:
            model = FeatureModel(None, None)
        return r6(model.transform(c).select(KEY, *cols))
    return fn


def _r6sql(n, e):
    frac = n in ("days_per_diagnosis", "procedure_intensity", "lab_intensity")
    return f"round({e}, 6) AS {n}" if frac else f"{e} AS {n}"


for _name, _cols in _GROUPS.items():
    query(_name)(_group_query(_name, _cols))
    oracle(_name, with_features(
        f"SELECT {KEY}, " + ", ".join(_r6sql(c, c) for c in _cols) + " FROM feat"))


@query("feat_prior_inpatient")
def q_feat_prior_inpatient(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        KEY, X.flag(F.col("number_inpatient") > 0).alias("has_prior_inpatient"))


oracle("feat_prior_inpatient", with_cleaned(
    f"SELECT {KEY}, CASE WHEN number_inpatient > 0 THEN 1 ELSE 0 END AS has_prior_inpatient FROM cleaned"))


def _nullq(c):
    return f"nullif({c}, '?')"


@query("icd_category")
def q_icd_category(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(KEY, *[X.icd_category(X.sentinel_null(d)).alias(f"{d}_category")
                           for d in ("diag_1", "diag_2", "diag_3")])


oracle("icd_category", with_encounter(
    f"SELECT {KEY}, " + ", ".join(f"{icd_sql(_nullq(d))} AS {d}_category"
                                  for d in ("diag_1", "diag_2", "diag_3")) + " FROM encounter"))


@query("icd_lookup")
def q_icd_lookup(spark, sf_dir):
    """The category lookup (16 ranges, External and Other: 18 fixed rows) with the
    number of primary codes in each, by a broadcast range join on the lookup (the
    bound is the table itself)."""
    look = spark.createDataFrame([(lo, hi, n) for lo, hi, n in C.ICD_RANGES],
                                 "lo int, hi int, category string")
    codes = encounters(spark, sf_dir).select(X.sentinel_null("diag_1").alias("code")) \
        .groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    num = X.icd_number("code")
    c = codes.withColumn("_num", num).withColumn(
        "_special", F.col("code").isNull() | F.col("code").isin(*C.ICD_OTHER_TOKENS)
        | F.regexp_replace("code", r"^\s+|\s+$", "").startswith("V")
        | F.regexp_replace("code", r"^\s+|\s+$", "").startswith("E"))
    j = c.join(F.broadcast(look), (F.col("_num") >= look.lo) & (F.col("_num") <= look.hi)
               & ~F.col("_special"), "left")
    cat = F.when(F.col("code").isNull() | F.col("code").isin(*C.ICD_OTHER_TOKENS), "Other") \
        .when(F.col("_special"), "External").otherwise(F.coalesce("category", F.lit("Other")))
    n = j.groupBy(cat.alias("category")).agg(F.sum("n").alias("n"))
    every = look.unionByName(spark.createDataFrame([(None, None, "External"), (None, None, "Other")], look.schema))
    return every.join(n, "category", "left").select("category", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


oracle("icd_lookup", with_encounter(
    "SELECT l.category, l.lo, l.hi, coalesce(c.n, 0) AS n FROM (VALUES "
    + ", ".join(f"('{n}', {lo}, {hi})" for lo, hi, n in C.ICD_RANGES) + ", ('External', NULL, NULL), ('Other', NULL, NULL)"
    + f") l(category, lo, hi) LEFT JOIN (SELECT {icd_sql('code')} AS category, cast(sum(n) AS BIGINT) AS n FROM "
    "(SELECT nullif(diag_1, '?') AS code, count(*) AS n FROM encounter GROUP BY 1) c GROUP BY 1) c USING (category)"))


@query("feature_pipeline")
def q_feature_pipeline(spark, sf_dir):
    return r6(featured(spark, sf_dir))


_FRAC = ("days_per_diagnosis", "procedure_intensity", "lab_intensity")
oracle("feature_pipeline", with_features(
    "SELECT " + ", ".join((f"round({c}, 6) AS {c}" if c in _FRAC else c)
                          for c in [c for c in CLEAN_COLS if c not in ("age", "gender", "diag_1", "diag_2", "diag_3")]
                          + [LABEL] + [n for n, _ in feature_exprs()]) + " FROM feat"))


@query("request_vectorise")
def q_request_vectorise(spark, sf_dir):
    """Serving vector: the request feature order, missing → 0.0, as an array."""
    from riskloom.operators.quality import REQUEST_FIELDS
    f = featured(spark, sf_dir)
    names = [n for n, typ, *_ in REQUEST_FIELDS if typ != "string"]
    vec = F.array(*[F.round(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), 6)
                    if n in f.columns else F.lit(0.0) for n in names])
    return f.select(KEY, vec.alias("features"))


def _vec_sql():
    from riskloom.operators.quality import REQUEST_FIELDS
    names = [n for n, typ, *_ in REQUEST_FIELDS if typ != "string"]
    return "[" + ", ".join(f"round(coalesce(cast({n} AS DOUBLE), 0.0), 6)" for n in names) + "]"


oracle("request_vectorise", with_features(f"SELECT {KEY}, {_vec_sql()} AS features FROM feat"))


@query("select_features")
def q_select_features(spark, sf_dir):
    from riskloom.operators.quality import REQUEST_FIELDS
    wanted = [n for n, *_ in REQUEST_FIELDS] + ["not_a_column"]
    return r6(K.select_features(featured(spark, sf_dir), wanted, keep=(KEY,)))


def _sel_sql():
    from riskloom.operators.quality import REQUEST_FIELDS
    from riskloom.plans.sqlparts import RAW_KEPT
    have = set(RAW_KEPT) | set(_FEXPR) | {LABEL}
    cols = [n for n, *_ in REQUEST_FIELDS if n in have]
    return ", ".join(f"round({c}, 6) AS {c}" if c in _FRAC else c for c in cols)


oracle("select_features", with_features(f"SELECT {KEY}, {_sel_sql()} FROM feat"))


# ---- 2.5 split ------------------------------------------------------------------
@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return stratified_split(c.select(KEY, LABEL), KEY, LABEL).select(KEY, LABEL, "split")


def split_sql(src: str, label: str = LABEL) -> str:
    """SQL CTEs ``cnt``, ``alloc``, ``splitted`` for the hash-ordered stratified split."""
    return f"""
hs AS (SELECT {KEY}, {label} AS lab, substr(md5(cast({KEY} AS VARCHAR) || '|{C.SEED}'), 1, 15) AS hx FROM {src}),
rk AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY hx, {KEY}) - 1 AS r FROM hs),
cnt AS (SELECT lab, count(*) AS n_c FROM hs GROUP BY lab),
t1 AS (SELECT *, ceil({C.TEST_SIZE}::DOUBLE * sum(n_c) OVER ()) AS n_take,
              ceil({C.TEST_SIZE}::DOUBLE * sum(n_c) OVER ()) * n_c / sum(n_c) OVER () AS ex FROM cnt),
t2 AS (SELECT *, floor(ex) AS fl, n_take - sum(floor(ex)) OVER () AS rem,
              row_number() OVER (ORDER BY ex - floor(ex) DESC, lab) AS pr FROM t1),
ta AS (SELECT lab, n_c, cast(fl + CASE WHEN pr <= rem THEN 1 ELSE 0 END AS BIGINT) AS test_c FROM t2),
v1 AS (SELECT *, n_c - test_c AS rest, ceil({C.VAL_SIZE}::DOUBLE * sum(n_c - test_c) OVER ()) AS v_take,
              ceil({C.VAL_SIZE}::DOUBLE * sum(n_c - test_c) OVER ()) * (n_c - test_c) / sum(n_c - test_c) OVER () AS ex FROM ta),
v2 AS (SELECT *, floor(ex) AS fl, v_take - sum(floor(ex)) OVER () AS rem,
              row_number() OVER (ORDER BY ex - floor(ex) DESC, lab) AS pr FROM v1),
alloc AS (SELECT lab, test_c, cast(fl + CASE WHEN pr <= rem THEN 1 ELSE 0 END AS BIGINT) AS val_c FROM v2),
splitted AS (SELECT rk.{KEY}, CASE WHEN r < test_c THEN 'test' WHEN r < test_c + val_c THEN 'val'
                    ELSE 'train' END AS split FROM rk JOIN alloc USING (lab))"""


oracle("stratified_split", with_cleaned(
    f"SELECT c.{KEY}, c.{LABEL}, s.split FROM cleaned c JOIN splitted s USING ({KEY})",
    split_sql("cleaned").strip()))


@query("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    s = stratified_split(c, KEY, LABEL)
    n_feat = len([x for x in c.columns if x not in (KEY, LABEL)])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                  F.lit(n_feat).alias("n_features"),
                                  F.round(F.avg(LABEL), 6).alias("positive_rate"))


oracle("dataset_profile", with_cleaned(
    f"SELECT split, count(*) AS rows, {len(CLEAN_COLS) - 1} AS n_features, "
    f"round(avg({LABEL}), 6) AS positive_rate FROM cleaned JOIN splitted USING ({KEY}) GROUP BY split",
    split_sql("cleaned").strip()))


# ---- train-fitted pipeline: encode, impute, scale, assemble -----------------------------
from riskloom.plans.sqlparts import PIPE_CATS, PIPE_NUMS, with_pipeline  # noqa: E402


def pipeline_result(spark, sf_dir):
    from riskloom.operators.pipeline import run_feature_pipeline
    return run_feature_pipeline(encounters(spark, sf_dir))


def _pipe_sql(body, extra=""):
    return with_pipeline(body, split_sql("cleaned"), extra)


@query("ordinal_encode")
def q_ordinal_encode(spark, sf_dir):
    from riskloom.operators.encode import OrdinalEncoder
    from riskloom.operators.features import FeatureEngineer
    c = cleaned(spark, sf_dir)
    s = stratified_split(c, KEY, LABEL).cache()
    tr = s.where(F.col("split") == "train")
    f = FeatureEngineer().fit(tr).transform(s).cache()
    enc = OrdinalEncoder(list(PIPE_CATS)).fit(f.where(F.col("split") == "train"))
    return enc.transform(f).select(KEY, "split", *PIPE_CATS)


oracle("ordinal_encode", _pipe_sql(f"SELECT {KEY}, split, " + ", ".join(PIPE_CATS) + " FROM enc"))


@query("median_impute")
def q_median_impute(spark, sf_dir):
    return r6(pipeline_result(spark, sf_dir).data.drop(LABEL, "split"))


oracle("median_impute", _pipe_sql(
    f"SELECT {KEY}, " + ", ".join(f"round({c}, 6) AS {c}" for c in PIPE_NUMS) + " FROM imp"))


@query("run_feature_pipeline")
def q_run_feature_pipeline(spark, sf_dir):
    return r6(pipeline_result(spark, sf_dir).data)


oracle("run_feature_pipeline", _pipe_sql(
    f"SELECT {KEY}, split, {LABEL}, " + ", ".join(f"round({c}, 6) AS {c}" for c in PIPE_NUMS)
    + " FROM imp"))

_SCALE = ["time_in_hospital", "num_lab_procedures", "total_prior_visits", "clinical_complexity",
          "lab_intensity", "n_active_medications"]


@query("standardise")
def q_standardise(spark, sf_dir):
    from riskloom.operators.encode import Standardiser
    d = pipeline_result(spark, sf_dir).data.cache()
    tr = d.where(F.col("split") == "train")
    model = Standardiser(_SCALE).fit(tr)
    return r6(model.transform(tr.select(KEY, *_SCALE)))


oracle("standardise", _pipe_sql(
    f"SELECT {KEY}, " + ", ".join(
        f"round((i.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END, 6) AS {c}" for c in _SCALE)
    + " FROM imp i CROSS JOIN st s WHERE i.split = 'train'",
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALE)
    + " FROM imp WHERE split = 'train')"))


@query("assemble_matrix")
def q_assemble_matrix(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    res = pipeline_result(spark, sf_dir)
    va = VectorAssembler(inputCols=sorted(res.feature_names), outputCol="features")
    v = va.transform(res.data)
    return v.select(KEY, LABEL, F.transform(vector_to_array("features"), lambda x: F.round(x, 6))
                    .alias("features"))


oracle("assemble_matrix", _pipe_sql(
    f"SELECT {KEY}, {LABEL}, [" + ", ".join(f"round({c}, 6)" for c in sorted(PIPE_NUMS)) + "] AS features FROM imp"))
