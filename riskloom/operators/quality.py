"""Data-quality audits, row-level constraints and quality gates.

The column checks (row count, missing %, ranges, class balance) share one
aggregation pass; duplicates and the target domain are one grouped pass each.
Every check yields rows ``(check, severity, metric, passed)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.exprs import safe_corr
from riskloom.functions import exprs as X

PURE_ROWS = 100
CHECK_SCHEMA = "check string, severity string, metric double, passed boolean"


def _row(check, severity, metric, passed):
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                    metric.cast("double").alias("metric"), passed.alias("passed"))


def column_audit(df: DataFrame, target=C.TARGET_COL, positive=C.POSITIVE_CLASS,
                 min_rows=C.MIN_ROWS, ranges=C.RANGE_CHECKS,
                 missing_pct=C.HIGH_MISSING_PCT) -> DataFrame:
    """min rows, missing %, ranges and class balance in one aggregation pass."""
    strs = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    n = F.count(F.lit(1))
    miss = {c: F.sum((F.col(c).isNull() | (F.col(c) == "?") if c in strs
                      else F.col(c).isNull()).cast("long")) for c in df.columns}
    present = [(c, lo, hi) for c, lo, hi in ranges if c in df.columns]
    out_of_range = {c: F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, lo, hi in present}
    if target not in df.columns:
        df = df.withColumn(target, F.lit(None).cast("string"))
    pos = F.avg(X.binary_target(target, positive).cast("double"))
    # distinct unexpected target values (NULL counts): the single distinct aggregate
    # partially aggregates on the few target values, so it rides in the same pass.
    unexpected = ~F.coalesce(F.col(target).isin(*C.TARGET_VALUES), F.lit(False))
    dom = F.count_distinct(F.when(unexpected, F.coalesce(F.col(target), F.lit("\u0000NULL"))))
    aggs = [n.alias("_n"), pos.alias("_pos"), dom.alias("_dom")]
    aggs += [v.alias(f"_m_{c}") for c, v in miss.items()]
    aggs += [v.alias(f"_r_{c}") for c, v in out_of_range.items()]
    a = df.agg(*aggs)
    rows = [_row("min_rows", "error", F.col("_n"), F.col("_n") >= min_rows),
            _row("target_domain", "error", F.col("_dom"), F.col("_dom") == 0)]
    n_high = sum((F.col(f"_m_{c}") * 100.0 / F.col("_n") > missing_pct).cast("int") for c in miss)
    rows.append(_row("missing", "warning", n_high, n_high == 0))
    for c, lo, hi in ranges:
        if c in out_of_range:
            m = F.col(f"_r_{c}")
            rows.append(_row(f"range:{c}", "warning", m, m == 0))
        else:
            rows.append(_row(f"range:{c}", "warning", F.lit(None), F.lit(False)))
    p = F.col("_pos")
    rows.append(_row("class_balance", F.when(p > C.POS_RATE_HIGH, "error").otherwise("warning"),
                     p, (p >= C.POS_RATE_LOW) & (p <= C.POS_RATE_HIGH)))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_report(df: DataFrame, threshold=C.HIGH_MISSING_PCT) -> DataFrame:
    """% missing per column after '?' → NULL, ranked descending (ties by name)."""
    strs = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cols = df.columns
    row = df.agg(*[(F.avg((F.col(c).isNull() | (F.col(c) == "?") if c in strs
                           else F.col(c).isNull()).cast("double")) * 100).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) as (column, missing_pct)")
    w = F.row_number().over(Window.orderBy(F.desc("missing_pct"), "column"))
    # long has one row per column: a global window over it is bounded by the schema width.
    return long.select("column", F.round("missing_pct", 6).alias("missing_pct"),
                       (F.col("missing_pct") > threshold).alias("over_threshold"),
                       w.cast("long").alias("rank"))


def range_report(df: DataFrame, ranges=C.RANGE_CHECKS) -> DataFrame:
    present = [(c, lo, hi) for c, lo, hi in ranges if c in df.columns]
    a = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, lo, hi in present])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                     F.col(c).alias("n_out_of_range"), (F.col(c) == 0).alias("passed"))
            for c, lo, hi in present]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_audit(df: DataFrame, key="encounter_id") -> DataFrame:
    """Rows beyond the first per key (NULL keys form one group, as pandas does)."""
    if key not in df.columns:
        return df.sparkSession.createDataFrame([("duplicates", "warning", None, False)],
                                               CHECK_SCHEMA)
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("d"))
    return a.select(F.lit("duplicates").alias("check"), F.lit("warning").alias("severity"),
                    F.col("d").cast("double").alias("metric"), (F.col("d") == 0).alias("passed"))


def domain_diff(df: DataFrame, target=C.TARGET_COL, allowed=C.TARGET_VALUES) -> DataFrame:
    """Target values outside the allowed set (NULL counts as unexpected), with counts."""
    vals = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return vals.where(~F.coalesce(F.col(target).isin(*allowed), F.lit(False))) \
        .select(F.col(target).alias("value"), "n")


def domain_audit(df: DataFrame, target=C.TARGET_COL, allowed=C.TARGET_VALUES) -> DataFrame:
    d = domain_diff(df, target, allowed).agg(F.count(F.lit(1)).alias("u"))
    return d.select(F.lit("target_domain").alias("check"), F.lit("error").alias("severity"),
                    F.col("u").cast("double").alias("metric"), (F.col("u") == 0).alias("passed"))


def leakage_audit(df: DataFrame, target=C.TARGET_COL, label=None) -> DataFrame:
    """Columns other than the target whose name contains 'readmit' (case-insensitive).

    With ``label`` given, numeric columns are also screened by |corr(c, label)|
    (one aggregation pass, ≥ 0.99 counts), and text columns by value: values of at
    least ``PURE_ROWS`` rows that all have one label count (a warning).
    """
    spark = df.sparkSession
    by_name = [c for c in df.columns if c != target and c != label and "readmit" in c.lower()]
    rows = [("leakage:name", "error", float(len(by_name)), len(by_name) == 0)]
    out = spark.createDataFrame(rows, CHECK_SCHEMA)
    if label is not None:
        from riskloom.operators.cleaning import numeric_columns, string_columns
        nums = numeric_columns(df, exclude=(label,))
        if nums:
            lab = F.col(label).cast("double")
            a = df.agg(*[F.abs(safe_corr(c, lab)).alias(c) for c in nums])
            n_hi = sum(F.coalesce(F.col(c) >= 0.99, F.lit(False)).cast("int") for c in nums)
            out = out.unionByName(a.select(F.lit("leakage:corr").alias("check"),
                                           F.lit("error").alias("severity"),
                                           n_hi.cast("double").alias("metric"),
                                           (n_hi == 0).alias("passed")))
        texts = [c for c in string_columns(df) if c not in (target, label)]
        if texts:
            long = df.select(F.col(label).alias("_y"), F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in texts])).alias("x")) \
                .select("_y", "x.*").where("value IS NOT NULL")
            by_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
            pure = F.count_if((F.col("n") >= PURE_ROWS) & ((F.col("pos") == 0) | (F.col("pos") == F.col("n"))))
            out = out.unionByName(by_value.agg(pure.alias("p")).select(
                F.lit("leakage:purity").alias("check"), F.lit("warning").alias("severity"),
                F.col("p").cast("double").alias("metric"), (F.col("p") == 0).alias("passed")))
    return out


def dq_report(df: DataFrame, key="encounter_id", target=C.TARGET_COL,
              min_rows=C.MIN_ROWS) -> DataFrame:
    """All checks, plus a ``verdict`` row: passed iff no error-severity check failed."""
    checks = (leakage_audit(df, target)
              .unionByName(duplicate_audit(df, key))
              .unionByName(column_audit(df, target, min_rows=min_rows))).cache()
    # checks is a handful of rows; cached so the verdict does not rescan the input.
    v = checks.agg(F.sum(((F.col("severity") == "error") & ~F.col("passed")).cast("int"))
                   .alias("e"))
    verdict = v.select(F.lit("verdict").alias("check"), F.lit("error").alias("severity"),
                       F.col("e").cast("double").alias("metric"), (F.col("e") == 0).alias("passed"))
    return checks.unionByName(verdict)


def gate_or_raise(report: DataFrame) -> bool:
    """Job-runner gate: raise when the verdict failed (the pipeline must stop)."""
    r = report.where(F.col("check") == "verdict").first()
    if r is None or not r["passed"]:
        raise RuntimeError("data validation failed")
    return True


# ---- row-level constraints (request schema) ---------------------------------
# Serving field constraints (name, type, required, ge, le, default).
REQUEST_FIELDS = (
    ("age_numeric", "double", True, 0, 9, None),
    ("gender", "int", True, -1, 1, None),
    ("age_risk_bucket", "string", True, None, None, None),
    ("total_prior_visits", "double", True, 0, None, None),
    ("high_utilizer", "int", True, 0, 1, None),
    ("has_number_inpatient", "int", False, 0, 1, 0),
    ("has_number_emergency", "int", False, 0, 1, 0),
    ("has_number_outpatient", "int", False, 0, 1, 0),
    ("time_in_hospital", "double", True, 1, 30, None),
    ("number_diagnoses", "double", True, 0, 20, None),
    ("num_medications", "double", True, 0, 100, None),
    ("num_lab_procedures", "double", True, 0, 200, None),
    ("num_procedures", "double", True, 0, 10, None),
    ("clinical_complexity", "double", False, 0, None, 0.0),
    ("days_per_diagnosis", "double", False, 0, None, 0.0),
    ("procedure_intensity", "double", False, 0, None, 0.0),
    ("lab_intensity", "double", False, 0, None, 0.0),
    ("a1c_tested", "int", False, 0, 1, 0),
    ("a1c_high", "int", False, 0, 1, 0),
    ("a1c_very_high", "int", False, 0, 1, 0),
    ("glucose_tested", "int", False, 0, 1, 0),
    ("glucose_high", "int", False, 0, 1, 0),
    ("both_labs_done", "int", False, 0, 1, 0),
    ("n_active_medications", "double", False, 0, None, 0.0),
    ("any_insulin", "int", False, 0, 1, 0),
    ("insulin_increased", "int", False, 0, 1, 0),
    ("insulin_decreased", "int", False, 0, 1, 0),
    ("any_med_change", "int", False, 0, 1, 0),
    ("on_diabetes_med", "int", False, 0, 1, 0),
    ("diag_1_category", "string", False, None, None, "Other"),
    ("diag_2_category", "string", False, None, None, "Other"),
    ("diag_3_category", "string", False, None, None, "Other"),
    ("primary_diag_high_risk", "int", False, 0, 1, 0),
    ("age_x_ndiagnoses", "double", False, None, None, 0.0),
    ("n_meds_x_ndiagnoses", "double", False, None, None, 0.0),
    ("inpatient_x_emergency", "double", False, None, None, 0.0),
    ("elderly_high_complexity", "int", False, 0, 1, 0),
    ("admission_type_id", "double", False, None, None, 0.0),
    ("discharge_disposition_id", "double", False, None, None, 0.0),
    ("admission_source_id", "double", False, None, None, 0.0),
)


def row_constraints(df: DataFrame, fields=REQUEST_FIELDS) -> DataFrame:
    """Apply defaults, then list violated constraints per row.

    Output: all input columns (defaults filled, declared types cast) plus
    ``violations array<string>``; a row is valid iff the array is empty.  A value
    that is no number of the declared type (text, or a fraction in an int field)
    is a ``type`` violation and becomes NULL; it never stops the job.
    Extra columns are allowed and passed through.
    """
    cols, checks = [], []
    declared = {f[0] for f in fields}
    for name, typ, required, ge, le, default in fields:
        raw = F.col(name) if name in df.columns else F.lit(None).cast(typ)
        v = raw
        if typ != "string":
            number = raw.try_cast("double")
            whole = number == F.floor(number)
            v = F.when(whole, number).cast("int") if typ == "int" else number
            checks.append(F.when(raw.isNotNull() & v.isNull(), F.lit(f"{name}:type")))
        if required:
            checks.append(F.when(raw.isNull(), F.lit(f"{name}:missing")))
        if ge is not None:
            checks.append(F.when(v < ge, F.lit(f"{name}:ge")))
        if le is not None:
            checks.append(F.when(v > le, F.lit(f"{name}:le")))
        if default is not None:
            v = F.coalesce(v, F.lit(default).cast(typ))
        cols.append(v.alias(name))
    extra = [F.col(c) for c in df.columns if c not in declared]
    return df.select(*extra, *cols, F.array_compact(F.array(*checks)).alias("violations"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = row_constraints(df)
    return (checked.where(F.size("violations") == 0).drop("violations"),
            checked.where(F.size("violations") > 0))


# ---- quality gates ----------------------------------------------------------
def quality_gate(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """metrics ``(metric, value)`` ⋈ gates → ``(metric, value, op, bound, passed)``."""
    # Three fixed gate rows.
    gates = spark.createDataFrame(
        [("auc_roc", ">=", C.GATE_MIN_AUC), ("average_precision", ">=", C.GATE_MIN_AP),
         ("ece", "<=", C.GATE_MAX_ECE)], "metric string, op string, bound double")
    j = F.broadcast(gates).join(metrics, "metric", "left")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")) \
        .otherwise(F.col("value") <= F.col("bound"))
    return j.select("metric", "value", "op", "bound", F.coalesce(passed, F.lit(False)).alias("passed"))
